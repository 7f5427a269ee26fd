"""Arrays in the shared folder: written by one task, memory-mapped by others."""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

#: Files that a worker keeps open.
MOST_OPEN = 256
#: Bytes that a worker keeps of files that cannot be mapped.
MOST_HELD = 256 << 20


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder; ``file:/x`` is Hadoop's spelling."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays as one file in one step: a second attempt of a task writes the
    same content, and no reader sees half of it.  The file begins with 8 bytes, the
    length of the line of JSON after them, which tells types and places."""
    store, path = resolve(folder)
    store.create_dir(path, recursive=True)
    told, at = [], 0
    for a in arrays:
        told.append([a.dtype.str, len(a), at])
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(told).encode()
    head += b" " * (-(len(head) + 8) % 64)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(bytes(-a.nbytes % 64))
    store.move(draft, f"{path}/{name}")


class Shelf:
    """The arrays of a folder's files, memory-mapped; the files used last stay open.
    Where the store isn't a mounted folder, a file is read into memory instead, and
    at most MOST_HELD bytes are kept; nothing is copied to a local disk."""

    def __init__(self, folder: str, most: int = MOST_OPEN) -> None:
        self.store, self.path = resolve(folder)
        self.most, self.held = most, 0
        self.open: OrderedDict[str, tuple[list[np.ndarray], int]] = OrderedDict()

    def __call__(self, name: str) -> list[np.ndarray]:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name][0]
        file, size = f"{self.path}/{name}", 0
        if isinstance(self.store, fs.LocalFileSystem):
            handle = os.open(file, os.O_RDONLY)
            try:
                data = memoryview(mmap.mmap(handle, 0, access=mmap.ACCESS_READ))
            finally:
                os.close(handle)
        else:
            with self.store.open_input_stream(file) as source:
                data = memoryview(source.read())
            size = len(data)
        head = int.from_bytes(data[:8], "little")
        start = 8 + head
        arrays = [np.frombuffer(data, t, n, start + at) for t, n, at in json.loads(bytes(data[8:start]))]
        self.open[name] = (arrays, size)
        self.held += size
        while len(self.open) > self.most or (self.held > MOST_HELD and len(self.open) > 1):
            self.held -= self.open.popitem(last=False)[1][1]
        return arrays
