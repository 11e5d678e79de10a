"""Secret scans with multipart credential linking.

Native: Spark's regular expressions and windows. Matches and the gaps between them come from the same pattern
(``regexp_extract_all`` and ``split``), and running sums of their lengths give offsets in code points. Only
lengths leave the scan; the texts aren't shuffled.

Base spans (assignments, access identifiers, hex runs) are reported always. Weak candidates are parts that mean
little alone: user identifiers and short access identifiers, short secrets and hex runs, endpoints. The parts of a
document are intervals, and two of them share a scope if at most ``SCOPE`` code points lie between. A part whose scope
holds an access identifier, a secret and an endpoint, itself among them, is an anchor; all parts in the scope
of an anchor are linked, and a weak candidate is reported only if it is. Sorted by start, the nearest part of a role
on either side decides, so the interval join is a few running maxima and minima and makes no pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Code points that may lie between a part and its complements.
SCOPE = 200

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
USER = r"""(?i)(username|user|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)"""
KEY = r"""(?i)(access_?key|private_?key|passphrase|pwd)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ENDPOINT = r"""(?i)(https|http|ftp|ssh|postgresql|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""

#: Kinds in the order of ties, and the part that each plays.
KINDS = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
_ORDER = list(KINDS)


def _parts(text: Column, number: int, pattern: str, group: int, kind: Callable[[Column, Column], Column], needs: list[str]) -> Column:
    """The matches of a pattern as structs (kind, gap, size, pattern): ``gap`` is the length of what lies before. ``kind`` is of a match and its group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    of_group = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(found.alias("m"), of_group.alias("g"), gaps.alias("gap"))
    each = F.transform(
        F.filter(zipped, lambda x: x["m"].isNotNull()),
        lambda x: F.struct(kind(x["m"], x["g"]).cast("int").alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"), F.lit(number).alias("pattern")),
    )
    may = F.lit(True)
    if needs:
        may = reduce(or_, (F.contains(text, F.lit(need)) for need in needs))
    return F.when(may, each).otherwise(F.array().cast("array<struct<kind:int,gap:int,size:int,pattern:int>>"))


def _code(name: str) -> Column:
    return F.lit(_ORDER.index(name))


def _kinds() -> list[tuple[str, int, Callable[[Column, Column], Column], list[str]]]:
    """Pattern, group, the match's kind (null: it is dropped), and strings of which a text with a match contains one."""
    return [
        (ASSIGN, 2, lambda m, g: F.when(F.length(g) >= 6, _code("assign")).when(F.length(g) >= 4, _code("weak_secret")), [":", "="]),
        (ACCESS, 0, lambda m, g: F.when(F.length(m) >= 20, _code("access")).when(F.length(m) >= 8, _code("weak_id")), ["AKIA"]),
        (HEX, 0, lambda m, g: F.when(F.length(m) >= 24, _code("hex")).when(m.rlike("[0-9]") & m.rlike("[a-f]"), _code("weak_secret")), []),
        (USER, 2, lambda m, g: F.when(F.length(g) >= 3, _code("weak_id")), [":", "="]),
        (KEY, 2, lambda m, g: F.when(F.length(g) >= 4, _code("weak_secret")), [":", "="]),
        (ENDPOINT, 0, lambda m, g: _code("endpoint"), ["://"]),
    ]


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, links.

    A span is kind:start:end in code points, the end exclusive; spans are sorted by start, then by kind as in
    ``KINDS``, and joined by commas. ``base_sha256`` is the digest of the first three kinds' alone. ``links`` has the linked
    parts, base ones too, each as group/span: groups are numbered from 1 in a document and lie more than a scope apart. A null text is
    an empty one: no spans, and the digest of the empty string. Repeated rows and ids are told apart
    by their place in the input. Other columns are ignored; an empty table gives none.
    """
    arrays = [_parts(F.col("text"), i, *kind) for i, kind in enumerate(_kinds())]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    parts = rows.select("doc_id", "row", F.concat(*arrays).alias("parts")).select("doc_id", "row", F.posexplode_outer("parts").alias("nth", "part"))
    parts = parts.select("doc_id", "row", "nth", "part.*").repartition("row")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(W.partitionBy("row", "pattern").orderBy("nth"))
    placed = parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    # Matches of no kind were needed for the sums only; a text without any keeps its row.
    role = F.element_at(F.array(*[F.lit(r) for r in KINDS.values()]), F.col("kind") + 1)
    order = W.partitionBy("row").orderBy("start", "kind", "end")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)

    def meets(which: Column) -> Column:
        """Whether the part itself or one in its scope is ``which``."""
        left = F.max(F.when(which, F.col("end"))).over(before) >= F.col("start") - scope
        right = F.min(F.when(which, F.col("start"))).over(after) <= F.col("end") + scope
        return F.coalesce(which, F.lit(False)) | F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    linked = placed.withColumn("role", role)
    anchors = linked.withColumn("anchor", F.col("kind").isNotNull() & meets(F.col("role") == "id") & meets(F.col("role") == "secret") & meets(F.col("role") == "endpoint"))
    told = anchors.withColumn("linked", F.col("kind").isNotNull() & meets(F.col("anchor"))).withColumn("told", F.col("kind").isNotNull() & ((F.col("kind") < 3) | F.col("linked")))
    apart = F.col("linked") & (F.col("start") - scope > F.coalesce(F.max(F.when(F.col("linked"), F.col("end"))).over(before), F.lit(-scope - 1)))
    told = told.withColumn("apart", apart).withColumn("group", F.sum(F.col("apart").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    item = F.struct("start", "kind", "end")
    grouped = told.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.coalesce(F.sum((F.col("kind") == i).cast("long")), F.lit(0)).cast("long").alias(f"n_{_ORDER[i]}") for i in range(3)],
        F.array_sort(F.collect_list(F.when(F.col("told"), item))).alias("items"),
        F.array_sort(F.collect_list(F.when(F.col("linked"), F.struct("start", "kind", "end", "group")))).alias("links"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda items: F.concat_ws(",", F.transform(items, one))
    base = joined(F.filter("items", lambda x: x["kind"] < 3))
    links = F.concat_ws(",", F.transform("links", lambda x: F.concat_ws("/", x["group"].cast("string"), one(x))))
    return grouped.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("items")).alias("spans"), links.alias("links"))


def _sql_part(pattern: str, group: int, number: int, kind: str) -> str:
    quoted = pattern.replace("'", "''")
    found = f"regexp_extract_all(text, '{quoted}', 0)"
    return f"""
      SELECT row, {number} AS pattern, nth, length(gap) AS gap, length(m) AS size, {kind} AS kind
      FROM (SELECT row, unnest(range(len({found}))) AS nth, unnest({found}) AS m, unnest(regexp_extract_all(text, '{quoted}', {group})) AS g,
                   unnest(list_slice(regexp_split_to_array(text, '{quoted}'), 1, len({found}))) AS gap
            FROM t WHERE regexp_matches(text, '{quoted}'))"""


def oracle_sql(scope: int = SCOPE) -> str:
    """DuckDB SQL for the rows of ``find_secrets`` over ``documents``."""
    kinds = (
        "CASE WHEN length(g) >= 6 THEN 0 WHEN length(g) >= 4 THEN 4 END",
        "CASE WHEN length(m) >= 20 THEN 1 WHEN length(m) >= 8 THEN 3 END",
        "CASE WHEN length(m) >= 24 THEN 2 WHEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-f]') THEN 4 END",
        "CASE WHEN length(g) >= 3 THEN 3 END",
        "CASE WHEN length(g) >= 4 THEN 4 END",
        "5",
    )
    parts = " UNION ALL ".join(_sql_part(p, group, i, k) for i, ((p, group, _, _), k) in enumerate(zip(_kinds(), kinds, strict=True)))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    roles = "[" + ", ".join(f"'{k}'" for k in KINDS.values()) + "]"
    before = "(PARTITION BY row ORDER BY start, kind, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = "(PARTITION BY row ORDER BY start, kind, stop ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    meets = lambda which: f"({which} OR coalesce(max(stop) FILTER ({which}) OVER {before} >= start - {scope}, false) OR coalesce(min(start) FILTER ({which}) OVER {after} <= stop + {scope}, false))"
    anchor = " AND ".join(meets(f"(role = '{r}')") for r in ("id", "secret", "endpoint"))
    return f"""
    WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    parts AS ({parts}),
    placed AS (SELECT row, kind, size, sum(gap + size) OVER (PARTITION BY row, pattern ORDER BY nth) AS stop FROM parts),
    kinds AS (SELECT row, kind, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, ({roles})[kind + 1] AS role FROM placed WHERE kind IS NOT NULL),
    anchors AS (SELECT row, kind, start, stop, ({names})[kind + 1] || ':' || start || ':' || stop AS span, kind < 3 AS base, {anchor} AS anchor FROM kinds),
    told AS (SELECT *, {meets("anchor")} AS linked FROM anchors),
    edges AS (SELECT *, linked AND start - {scope} > coalesce(max(stop) FILTER (linked) OVER {before}, {-scope - 1}) AS apart FROM told),
    numbered AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY row ORDER BY start, kind, stop ROWS UNBOUNDED PRECEDING) AS grp FROM edges),
    sums AS (
      SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
             string_agg(span, ',' ORDER BY start, kind, stop) FILTER (base) AS bases,
             string_agg(span, ',' ORDER BY start, kind, stop) FILTER (base OR linked) AS spans,
             string_agg(grp || '/' || span, ',' ORDER BY start, kind, stop) FILTER (linked) AS links
      FROM numbered GROUP BY row)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
           sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links
    FROM t LEFT JOIN sums USING (row)"""
