"""Routing of questions to modalities by the words in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that point to a modality, in the order in which modalities are named.
ROUTES = {
    "image": ("image", "ảnh", "jpg", "png"),
    "tabular": ("csv", "correlation", "excel", "xlsx"),
    "text": ("html", "wiki"),
    "document": ("pdf", "project"),
    "epub": ("epub", "light novel", "novel", "chapter"),
    "audio": ("audio", "m4a", "meeting", "workshop", "participants"),
    "video": ("video", "mp4", "mkv", "frame"),
}
#: Words, and modalities after those, that this library adds.
MORE = {
    "image": ("picture", "photo", "figure", ".jpeg"),
    "tabular": ("spreadsheet", "column", "average"),
    "document": ("docx", "report", "paper"),
    "epub": ("book",),
    "audio": ("speech", "recording", ".mp3", ".wav"),
    "video": ("clip",),
    "database": ("database", "sqlite", ".db"),
    "slideshow": ("slide", "presentation", ".ppt"),
    "web": ("web page", "website"),
    "sql_script": (".sql", "sql script"),
}
# Fixed value: where to look without any word.
DEFAULT = ("text", "tabular", "document")


def route(question: str | Column) -> Column:
    """Array of modalities that the question's words point to, in a fixed order;
    the default ones if there are none.  Nothing but words is looked at."""
    low = F.lower(F.col(question) if isinstance(question, str) else question)

    def says(name: str) -> Column:
        words = (*ROUTES.get(name, ()), *MORE.get(name, ()))
        return F.greatest(*(F.contains(low, F.lit(w)) for w in words), F.lit(False))

    # Scripts that make tables are read as text.
    says_text = says("text") | (says("tabular") & F.contains(low, F.lit("sql")))
    hits = [F.when(says_text if name == "text" else says(name), F.lit(name)) for name in dict.fromkeys((*ROUTES, *MORE))]
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, DEFAULT)))
