"""Secret scans by multipart credential linking.

Three base kinds are reported wherever they stand. Weak parts prove nothing alone: short or named access
identifiers, user names, passwords too short to count, mixed runs and short hexadecimal ones, addresses of
services. They are intervals in their document, joined with the intervals of complementary roles that lie within
``REACH`` code points, and reported only where such a part co-occurs: an identifier needs a secret, a secret an
identifier, an endpoint both. Base kinds are complements too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm import arrowtext as A
from wayspark.llm.common import arrow_rows, free_name, table, written

#: Kinds in order; those from the fourth on are weak.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
N_BASE = 3
#: What a kind can stand for when others look for complements.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "weak_endpoint": "endpoint"}
NEEDS = {"weak_id": ("secret",), "weak_secret": ("id",), "weak_endpoint": ("id", "secret")}
REACH = 200
MASK = "[SECRET]"

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
NAMED_ID = r"""(user(name)?|login|(client|account|access|key|tenant|user)[_-]?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]+"""
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|(host|server|endpoint)(name)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(:[0-9]+)?"""
#: Least lengths: values of assignments, access identifiers and hexadecimal runs (weak from the second on), mixed runs.
MIN_VALUE, MIN_WEAK_VALUE, MIN_ACCESS, MIN_WEAK_ACCESS, MIN_HEX, MIN_WEAK_HEX, MIN_MIXED = 6, 4, 20, 8, 24, 16, 20
_assign, _access, _id, _endpoint = (re.compile(p, f) for p, f in ((ASSIGN, re.I | re.A), (ACCESS, 0), (NAMED_ID, re.I | re.A), (ENDPOINT, re.I | re.A)))
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ID_WORDS = ("user", "login", "id")
_END_WORDS = ("://", "host", "server", "endpoint")

_HEX, _SECRET = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_HEX[48:58] = _HEX[97:103] = True
_SECRET[48:58] = _SECRET[65:91] = _SECRET[97:123] = True
_SECRET[[ord(c) for c in "+/_-"]] = True
PARTS = "array<struct<kind:int,start:int,end:int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _long_runs(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    """Row -> byte ranges of the chunk, of runs of at least ``least`` bytes."""
    starts, ends, rows = A.runs(mask[data], offsets)
    out: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero(ends - starts >= least):
        out.setdefault(int(rows[k]), []).append((int(starts[k]), int(ends[k])))
    return out


def _mixed(s: bytes) -> bool:
    return bool(re.search(rb"[0-9]", s) and re.search(rb"[A-Z]", s) and re.search(rb"[a-z]", s))


def _scan(texts: pa.Array) -> pa.Array:
    found: list[list[dict]] = []
    for lo, hi, data, offsets in A.chunks(texts):
        hexes = _long_runs(data, offsets, _HEX, MIN_WEAK_HEX)
        mixed = _long_runs(data, offsets, _SECRET, MIN_MIXED)
        # code points before each byte, counted once for the chunk
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        raw = data.tobytes()
        for i in range(hi - lo):
            text, parts = raw[offsets[i] : offsets[i + 1]].decode(), []
            low = text.lower()
            if any(k in low for k in _KEYWORDS):
                parts += [(0 if len(m[2]) >= MIN_VALUE else 4, *m.span()) for m in _assign.finditer(text) if len(m[2]) >= MIN_WEAK_VALUE]
            if "AKIA" in text:
                parts += [(1 if m.end() - m.start() >= MIN_ACCESS else 3, *m.span()) for m in _access.finditer(text) if m.end() - m.start() >= MIN_WEAK_ACCESS]
            point = lambda b: int(points[b] - points[offsets[i]])  # noqa: B023, E731
            parts += [(2 if b - a >= MIN_HEX else 4, point(a), point(b)) for a, b in hexes.get(i, ())]
            parts += [(4, point(a), point(b)) for a, b in mixed.get(i, ()) if _mixed(raw[a:b])]
            if any(k in low for k in _ID_WORDS):
                parts += [(3, *m.span()) for m in _id.finditer(text)]
            if any(k in low for k in _END_WORDS):
                parts += [(5, *m.span()) for m in _endpoint.finditer(text)]
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(set(parts), key=lambda p: (p[1], p[0], p[2]))])
    return pa.array(found, type=_TYPE)


def scan(text: Column) -> Column:
    """All parts of a text, weak ones too, by start, then kind; none for null."""

    @F.arrow_udf(PARTS)
    def scanned(texts: pa.Array) -> pa.Array:
        return _scan(texts)

    return scanned(text)


def _linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Of (uid, kind, start, end): the weak ones whose complements lie within reach, in the same scope (uid).

    An interval join: parts are laid out in bins as long as the reach, and a weak part looks into the bins its
    reach touches. Parts of one kind don't overlap, so a bin holds a bounded number of them, however many the
    document has.
    """
    role = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])))
    offers = parts.select("uid", F.element_at(role, F.col("kind")).alias("role"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))).alias("bin"))
    weak = parts.where(F.col("kind") >= N_BASE).select("uid", "kind", "start", "end", F.floor((F.col("start") - reach) / reach).alias("b0"), F.floor((F.col("end") + reach) / reach).alias("b1"))
    looks = weak.select("uid", "kind", "start", "end", F.explode(F.sequence("b0", "b1")).alias("bin"))
    near = (F.col("w.start") - F.col("o.end") <= reach) & (F.col("o.start") - F.col("w.end") <= reach)
    out = None
    for k, roles in NEEDS.items():
        mine = looks.where(F.col("kind") == KINDS.index(k))
        kept = mine.select("uid", "kind", "start", "end").distinct()
        for r in roles:
            # a part is no complement of itself, nor of a part that covers the same text
            other = near & ((F.col("o.start") >= F.col("w.end")) | (F.col("o.end") <= F.col("w.start")))
            met = mine.alias("w").join(offers.where(F.col("role") == r).alias("o"), (F.col("w.uid") == F.col("o.uid")) & (F.col("w.bin") == F.col("o.bin")) & other, "left_semi")
            kept = kept.join(met.select("uid", "kind", "start", "end").distinct(), ["uid", "kind", "start", "end"], "left_semi")
        out = kept if out is None else out.unionByName(kept)
    return out


def _with_links(rows: DataFrame, uid: str, parts: str, reach: int) -> DataFrame:
    """``rows`` with ``parts`` cut down to base parts and linked weak ones. Only rows with weak parts are joined."""
    some = F.exists(parts, lambda p: p["kind"] >= N_BASE)
    base = F.filter(parts, lambda p: p["kind"] < N_BASE)
    each = rows.where(some).select(F.col(uid).alias("uid"), F.inline(parts))
    linked = free_name(rows, "linked")
    kept = _linked(each, reach).groupBy(F.col("uid").alias(uid)).agg(F.collect_list(F.struct("kind", "start", "end")).alias(linked))
    joined = rows.where(some).join(kept, uid, "left")
    both = F.concat(base, F.coalesce(linked, F.array().cast(PARTS)))
    ordered = F.transform(F.array_sort(F.transform(both, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    joined = joined.withColumn(parts, ordered).select(rows.columns)
    return rows.where(~some).unionByName(joined)


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id and ``parts``, an array of (kind, start, end): code points, end exclusive, by start, then kind;
    one row per row of ``docs``.

    Null texts have no parts, repeated rows give repeated rows, an empty table gives none, extra columns are
    ignored. Texts are scanned whole. Parts of equal start stand by kind, then end.
    """
    arrow_rows(docs.sparkSession)
    rows = written(docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), scan(F.col("text")).alias("parts")), "secrets")
    return _with_links(rows, "uid", "parts", reach).select("doc_id", "parts")


def _redact(texts: pa.Array, parts: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), parts.to_pylist()):
        if text is not None and own:
            pieces, at = [], 0
            for p in own:  # by start; what overlaps the last mask is under it
                if p["start"] >= at:
                    pieces += [text[at : p["start"]], MASK]
                at = max(at, p["end"])
            text = "".join(pieces) + text[at:]
        out.append(text)
    return pa.array(out, type=pa.string())


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with every reported secret masked in ``text`` and ``n_chars``, if it is there, made to agree.
    No row is dropped; null texts and texts without secrets stay as they are; repeated rows repeat, an empty
    table stays empty, and other columns are kept whatever their names."""
    arrow_rows(docs.sparkSession)
    uid, parts = free_name(docs, "row_key"), free_name(docs, "row_parts")
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()).withColumn(parts, scan(F.col("text"))), "scanned")

    @F.arrow_udf("string")
    def masked(texts: pa.Array, own: pa.Array) -> pa.Array:
        return _redact(texts, own)

    held = _with_links(rows, uid, parts, reach)
    hit = F.size(parts) > 0
    changed = held.where(hit).withColumn("text", masked(F.col("text"), F.col(parts)))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return held.where(~hit).unionByName(changed).select(docs.columns)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    name = F.array(*(F.lit(k) for k in KINDS))
    base = F.filter("parts", lambda p: p["kind"] < N_BASE)
    spell = lambda a: F.array_join(F.transform(a, lambda p: F.concat_ws(":", F.get(name, p["kind"]), p["start"].cast("string"), p["end"].cast("string"))), ",")
    of = lambda i: F.filter("parts", lambda p: p["kind"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{KINDS[i]}") for i in range(N_BASE)]
    return found.select("doc_id", *counts, F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("parts")).alias("spans"))


#: The same rows in DuckDB.
OP10_SQL = r"""
with p(pat, kind) as (values
    ('(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 0), ('AKIA[A-Z0-9]+', 1), ('[0-9a-f]{16,}', 2),
    ('(?i)(?:user(?:name)?|login|(?:client|account|access|key|tenant|user)[_-]?id)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9._@-]+', 3), ('[A-Za-z0-9+/_-]{20,}', 4),
    ('(?i)[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|(?:host|server|endpoint)(?:name)?["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9.-]+(?::[0-9]+)?', 5)),
d as (select row_number() over () as uid, doc_id, coalesce(text, '') as text from documents),
x as (select uid, kind, string_split_regex(text, pat) as gaps, regexp_extract_all(text, pat) as ms from d, p where regexp_matches(text, pat)),
y as (select uid, kind, unnest(range(1, len(ms) + 1)) as i, gaps, ms from x),
z as (select uid, kind, i, length(gaps[i]) as g, ms[i] as m from y),
s as (select uid, kind, m, sum(g + length(m)) over (partition by uid, kind order by i) as e, length(m) as n from z),
v as (select *, length(regexp_extract(m, '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) as len from s),
a as (select distinct uid, case when kind = 0 and len < 6 then 4 when kind = 1 and n < 20 then 3 when kind = 2 and n < 24 then 4 else kind end as kind,
    cast(e - n as int) as s, cast(e as int) as e from v
  where not (kind = 0 and len < 4) and not (kind = 1 and n < 8)
    and not (kind = 4 and not (regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]')))),
o as (select *, case when kind in (1, 3) then 'id' when kind = 5 then 'endpoint' else 'secret' end as role from a),
l as (select w.uid, w.kind, w.s, w.e, count(distinct o.role) as roles from o w join o on w.uid = o.uid and w.s - o.e <= 200 and o.s - w.e <= 200
    and (o.s >= w.e or o.e <= w.s)
    and ((w.kind = 3 and o.role = 'secret') or (w.kind = 4 and o.role = 'id') or (w.kind = 5 and o.role in ('id', 'secret')))
  where w.kind > 2 group by all),
f as (select uid, kind, s, e from a where kind < 3 union all select uid, kind, s, e from l where roles = case when kind = 5 then 2 else 1 end),
t as (select uid, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2,
    string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind) filter (kind < 3) as base,
    string_agg(['assign', 'access', 'hex', 'weak_id', 'weak_secret', 'weak_endpoint'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind, e) as spans
  from f group by uid)
select doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join t using (uid)
"""
