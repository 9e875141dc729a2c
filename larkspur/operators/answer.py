"""The whole answer to a free-text query: streets and addresses with highlights, from precomputed answers where there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.highlight import highlight
from ..functions.parse import parse
from ..sources.psv import read_answer
from . import search
from .search import MOST, street_hits

_STREET = ["street_id", "display", "street_name", "street_type_abbrev", "street_suffix_code", "locality_name", "state", "postcode", "address_count"]


def _parts(row: dict, prefix: str = "") -> dict:
    return {"prefix": prefix, "street_name": row["street_name"], "street_type": row["street_type_abbrev"], "street_suffix": row["street_suffix_code"], "locality": row["locality_name"], "state": row["state"], "postcode": row["postcode"]}


def checked(query: str | None, limit: int | str | None = 10) -> tuple[str, int]:
    """The trimmed query and the limit, at most MOST; ValueError for an empty query."""
    q = (query or "").strip()
    if not q:
        raise ValueError("Query must be at least 1 character")
    return q, min(int(limit if limit is not None else 10), MOST)


def answer(spark: SparkSession, streets: DataFrame, index: DataFrame, entries: DataFrame, query: str | None, limit: int | str | None = 10, threshold: int = 100, precomputed: str | None = None) -> dict[str, list[dict]]:
    """{streets, addresses} with at most `limit` of each, in order, with the ranges of their text that the query matches.

    precomputed: folder of the answers of short queries, read if it holds the query. One letter that isn't there finds
    nothing, as does a query without words. These rows are all that reaches the driver.
    """
    q, limit = checked(query, limit)
    ready = read_answer(spark, precomputed, " ".join(q.lower().split())) if precomputed else None
    if ready is not None and (rows := ready.orderBy("kind", "place").collect()):
        return {f"{kind}s" if kind == "street" else f"{kind}es": [{"street_id": r["street_id"], "gnaf_pid": r["gnaf_pid"], "text": r["text"], "score": r["score"]} for r in rows if r["kind"] == kind][:limit] for kind in ("street", "address")}
    parsed = parse(q)
    if len(q) < 2 or (parsed is None and not (q.isascii() and q.isdigit())):
        return {"streets": [], "addresses": []}
    listed = []
    if parsed is not None:
        for r in street_hits(streets, index, parsed, limit).select(*_STREET, "street_rank").orderBy("street_rank").collect():
            row = r.asDict()
            listed.append({k: row[k] for k in ("street_id", "display", "street_name", "locality_name", "state", "postcode", "address_count")} | {"highlight": highlight(row["display"], _parts(row), q)})
    found = search.search(streets, index, entries, q, limit, threshold)
    shown = found.join(streets.select(*_STREET), "street_id").join(entries.select("gnaf_pid", "display_prefix"), "gnaf_pid").collect() if found is not None else []
    by_pid = {r["gnaf_pid"]: r.asDict() for r in shown}
    places = [r["gnaf_pid"] for r in found.select("gnaf_pid").collect()] if found is not None else []
    addresses = [{"gnaf_pid": p, "sla": by_pid[p]["sla"], "street_id": by_pid[p]["street_id"], "highlight": highlight(by_pid[p]["sla"], _parts(by_pid[p], by_pid[p]["display_prefix"] or ""), q)} for p in places]
    return {"streets": listed, "addresses": addresses}
