"""Filters, order and page of a catalogue as a URL's query string."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode

from vellum.operators.catalogue import STATUSES, Filters

# Parameter of each facet, whether its values are parted by commas, and its form.
LISTS = {
    "topics": ("topic", True, r".+"),
    "statuses": ("status", True, "|".join(STATUSES)),
    "authors": ("author", False, r".+"),
    "tags": ("tag", False, r".+"),
    "sources": ("scan", True, r"[A-Za-z0-9-]{1,64}"),
    "languages": ("lang", True, r"[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})?"),
    "decades": ("decade", True, r"-?\d{1,3}0|0"),
}
FLAGS = {"needs_review": "review", "favourites": "fav", "lent": "lent"}
#: A list has so many values at most, a search text so many characters (limits of the format, not of the data).
MOST_VALUES, LONGEST_QUERY = 50, 200


def parse(query: str, topics: set[str] | None = None) -> Filters:
    """Filters of a query string; values of another form, and topics outside ``topics``, are dropped, repeated ones are one."""
    pairs = parse_qsl(query.lstrip("?"), keep_blank_values=True)
    out = Filters(q=next((v for k, v in pairs if k == "q"), "")[:LONGEST_QUERY])
    for name, (key, parted, form) in LISTS.items():
        found = [p.strip() for k, v in pairs if k == key for p in (v.split(",") if parted else [v])]
        found = [v for v in found if re.fullmatch(form, v) and (name != "topics" or topics is None or v in topics)]
        kind = int if name == "decades" else str.lower if name == "languages" else str
        setattr(out, name, list(dict.fromkeys(map(kind, found)))[:MOST_VALUES])
    for name, key in FLAGS.items():
        setattr(out, name, next((v.strip().lower() in ("1", "true", "yes", "on", "") for k, v in pairs if k == key), False))
    return out


def canonical(filters: Filters) -> str:
    """The one query string of these filters: equal strings mean equal filters."""
    pairs = [("q", filters.q.strip()[:LONGEST_QUERY])] if filters.q.strip() else []
    for name, (key, parted, _) in LISTS.items():
        values = list(dict.fromkeys(sorted(getattr(filters, name)) if name == "decades" else getattr(filters, name)))[:MOST_VALUES]
        pairs += [(key, ",".join(map(str, values)))] if parted and values else [(key, v) for v in values]
    return urlencode(pairs + [(key, "1") for name, key in FLAGS.items() if getattr(filters, name)])
