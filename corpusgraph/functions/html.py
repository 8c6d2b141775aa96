"""The text of HTML mail: a small state machine over tags, comments, scripts and character references.

The text is that of all text nodes, in order, with a separator between them; markup ends a node, so ``a<b>c`` is two. Comments,
declarations and the content of script, style and template hold no text. What looks like a tag but is never closed is text. A
place is looked at a bounded number of times, so a mail takes time in proportion to its length.
"""

from __future__ import annotations

import re
from html.entities import html5

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A tag whose attributes may hold quoted ``>``; outside quotes a ``<`` ends the attempt.
_TAG = re.compile(r"""</?([a-zA-Z][^\s/><]*+)(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>""")
_REFERENCE = re.compile(r"&(?:#(?:([0-9]+)|[xX]([0-9a-fA-F]+))(?=[^0-9a-fA-F])|([a-zA-Z][-.a-zA-Z0-9]*)(?=[^a-zA-Z0-9]));?")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^<>]*>", re.IGNORECASE) for t in ("script", "style", "template")}


def _character(m: re.Match) -> str:
    if m[3]:
        return html5.get(m[3] + ";", "&" + m[3])
    code = int(m[1]) if m[1] else int(m[2], 16)
    if 0x80 <= code < 0xA0:
        return bytes([code]).decode("cp1252", "replace")
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def nodes(page: str) -> list[str]:
    """The text nodes of a page, in order."""
    out: list[str] = []
    at, look, n, last = 0, 0, len(page), page.rfind(">")

    def text(a: int, b: int) -> None:
        if a < b:
            out.append(_REFERENCE.sub(_character, page[a:b]))

    while at < n:
        lt = page.find("<", max(at, look))
        if lt < 0:
            text(at, n)
            break
        if page.startswith("<!--", lt):
            text(at, lt)
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif lt < last and page[lt + 1] in "!?":
            text(at, lt)
            at = page.find(">", lt) + 1
        elif lt < last and (m := _TAG.match(page, lt)):
            text(at, lt)
            at, tag = m.end(), m[1].lower()
            if tag in _END and page[lt + 1] != "/":
                end = _END[tag].search(page, at)
                at = end.end() if end else n
        else:
            look = lt + 1
    return out


@F.pandas_udf(StringType())
def to_text(page: pd.Series) -> pd.Series:
    """All text nodes, one line break between two; null counts as empty."""
    return page.map(lambda x: "\n".join(nodes(x or "")))
