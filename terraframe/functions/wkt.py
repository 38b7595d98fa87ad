"""Reading well-known text of reference systems by its nodes: keyword, bracket, then strings, numbers and nodes.

The text falls at its quotes into outer and quoted pieces in turn. A quoted piece is the first argument of a node if the outer piece
before it ends in a keyword and an opening bracket; brackets and keywords inside quotes are never taken for structure.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Keywords of nodes that hold an authority and a code, in either version of the format.
AUTHORITIES = ("AUTHORITY", "ID")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used: as the variable of a lambda."""
    return F.transform(F.array(value), use)[0]


def _keyword(outer: Column) -> Column:
    return F.upper(F.regexp_extract(outer, r"(\w+)\s*[\[(]\s*$", 1))


def _name(pieces: Column) -> Column:
    first = F.get(pieces, F.lit(1))
    return F.when((F.size(pieces) > 2) & F.get(pieces, F.lit(0)).rlike(r"^\w+\s*[\[(]\s*$") & (first != ""), first)


def _authority(pieces: Column) -> Column:
    def node(k: Column) -> Column:
        after = F.trim(F.get(pieces, k + 1))
        code = F.when(after == ",", F.get(pieces, k + 2)).otherwise(F.regexp_extract(after, r"^,\s*([0-9]+)", 1))
        return F.struct(F.get(pieces, k).alias("authority"), code.alias("code"), _keyword(F.get(pieces, k - 1)).alias("keyword"))

    # every second piece is quoted
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(pieces) - 1)), lambda i: (i % 2 == 1) & (i < F.size(pieces) - 1))
    holds = F.filter(F.transform(places, node), lambda n: n["keyword"].isin(*AUTHORITIES) & (n["authority"] != "") & n["code"].rlike("^[0-9]+$"))
    return F.get(F.reverse(holds), F.lit(0))


def root(wkt: Column) -> Column:
    """(authority, code, name): those of the last node that holds an authority and a code of digits, which is that of the whole, and the outermost
    node's first argument; null where there is none."""

    def parts(pieces: Column) -> Column:
        return bound(_authority(pieces), lambda n: F.struct(n["authority"].alias("authority"), n["code"].alias("code"), _name(pieces).alias("name")))

    return bound(F.split(wkt, '"'), parts)


def read(text: str) -> tuple[str | None, str | None, str | None]:
    """(authority, code, name) of a text, outside of Spark."""
    pieces = text.split('"')
    found = named = None
    for k in range(1, len(pieces) - 1, 2):
        head = re.search(r"(\w+)\s*[\[(]\s*$", pieces[k - 1])
        if head and k == 1 and not pieces[0][: head.start()].strip() and pieces[1]:
            named = pieces[1]
        if head and head[1].upper() in AUTHORITIES and pieces[k]:
            after = pieces[k + 1].strip()
            code = pieces[k + 2] if after == "," and k + 2 < len(pieces) else (re.match(r",\s*([0-9]+)", after) or [None, ""])[1]
            if re.fullmatch("[0-9]+", code):
                found = pieces[k], code
    return (*(found or (None, None)), named)
