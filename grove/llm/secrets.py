"""Secret scans with DataFrame functions only: patterns, and sliding-window entropy."""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table

# The base patterns; group 1 of assign is the value, of 8 characters or more.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
VALUE = 8

# Candidates for entropy, their alphabet, and the least bits by character class.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
WINDOW = 20
CLASSES = ((r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), (r"^([0-9a-z]+|[0-9A-Z]+)$", 3.5), (r"", 3.8))

# What is never a secret. Names and identifiers by form, then public values.
ALLOWED_FORMS = (
    r"^[A-Za-z+/_-]+$",  # no digit: words, paths, slugs
    r"^[0-9+/_-]+$",  # no letter: numbers, dates
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",  # UUID
    r"(?i)example|sample|placeholder|dummy|your[_-]?(key|token|secret)",
    r"(?i)0123456789abcdef|abcdefghijklmnop",  # alphabets
    r"(.)\1{7}",  # filler
)
ALLOWED_VALUES = (
    "d41d8cd98f00b204e9800998ecf8427e",  # digests of the empty input
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)


STRIDE = 256  # elements that one step of a running number, or of cutting a text, takes


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value bound once, as the one element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """An array of whole numbers to their sums so far (or maxima so far), each included.

    Growing an array one by one copies it each time, so strides are run through apart, and
    then what each stride hands on: a text of n spans costs about n * STRIDE / 2 copies.
    """

    def through(part: Column) -> Column:
        empty = F.expr("cast(array() as array<int>)")
        add = lambda out, v: F.array_append(out, F.when(F.size(out) > 0, join(F.element_at(out, -1), v)).otherwise(v))
        return F.aggregate(part, empty, add)

    strides = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRIDE).cast("int")), lambda i: through(F.slice(values, i * STRIDE + 1, STRIDE)))

    def carried(inner: Column) -> Column:
        ends = through(F.transform(inner, lambda part: F.element_at(part, -1)))
        return _once(ends, lambda all_ends: F.flatten(F.transform(inner, lambda part, i: F.when(i == 0, part).otherwise(F.transform(part, lambda v: join(F.get(all_ends, i - 1), v))))))

    return F.when(F.size(values) > 0, _once(strides, carried)).otherwise(values)


def _positions(text: Column, pattern: str, found: Column, kind: str) -> Column:
    """``found``, all matches of ``pattern``, as spans in code points: what stands between
    matches and the matches themselves alternate."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = _running(F.zip_with(gaps, found, lambda gap, hit: F.length(gap) + F.length(hit)), lambda a, b: a + b)
    spans = F.zip_with(found, ends, lambda hit, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("value")))
    return F.when(F.size(found) > 0, spans).otherwise(F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)"))


def _between(text: Column, edges: Column) -> Column:
    """The parts of a text between positions that follow each other, the first 0 and the last
    its length. Looking for a position means reading from the start, so the text is cut into
    stretches of ``STRIDE`` positions first."""

    def stretch(i: Column) -> Column:
        def cut(own: Column) -> Column:
            first = F.element_at(own, 1)
            fine = lambda piece: F.transform(F.sequence(F.lit(1), F.size(own) - 1), lambda j: F.substring(piece, F.element_at(own, j) - first + 1, F.element_at(own, j + 1) - F.element_at(own, j)))
            return _once(F.substring(text, first + 1, F.element_at(own, -1) - first), fine)

        return _once(F.slice(edges, i * STRIDE + 1, STRIDE + 1), cut)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(edges) - 2) / STRIDE).cast("int")), stretch))


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` characters side by side (of
    all, where there are fewer).

    One pass: the window keeps a count for each symbol and the sum of c log2 c; a step takes
    one character out and one in, so the sum changes by two terms.
    """
    term = F.array(*[F.lit(0.0 if c == 0 else c * log2(c)) for c in range(window + 1)])
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))

    def over(chars: Column) -> Column:
        size = F.least(F.size(chars), F.lit(window))

        def step(state: Column, i: Column) -> Column:
            enters = F.element_at(chars, i)
            leaves = F.when(i > window, F.element_at(chars, i - window)).otherwise(F.lit(-1))
            before_out = F.when(leaves >= 0, F.get(state["counts"], leaves)).otherwise(F.lit(0))
            less = F.when(leaves >= 0, F.get(term, before_out) - F.get(term, before_out - 1)).otherwise(F.lit(0.0))
            before_in = F.get(state["counts"], enters) - F.when(leaves == enters, 1).otherwise(0)
            more = F.get(term, before_in + 1) - F.get(term, before_in)
            total = state["sum"] - less + more
            counts = F.transform(state["counts"], lambda c, j: c + F.when(j == enters, 1).otherwise(0) - F.when(j == leaves, 1).otherwise(0))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= size, F.least(state["least"], total)).otherwise(state["least"]).alias("least"))

        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda s: F.log2(size.cast("double")) - s["least"] / size)

    return _once(codes, over)


def _suspicious(value: Column) -> Column:
    """Whether a candidate is random enough for its character class and not allowed."""
    allowed = F.lower(value).isin(*ALLOWED_VALUES)
    for form in ALLOWED_FORMS:
        allowed = allowed | value.rlike(form)
    least = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(value.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(value) >= least)


def with_spans(df: DataFrame, spans: str, text_col: str = "text") -> DataFrame:
    """``df`` with an array column ``spans`` of ``kind, start, end, value``, by start, then
    kind as in ``KINDS``. Narrow: no shuffle, no Python; the work grows with the text and,
    times the logarithm, with its spans.

    A null or empty text has no spans. Entropy spans are candidates in which some window is
    at least as random as their character class asks for, unless a pattern's span covers
    them or they are on the allow-list, which never takes a pattern's span away.
    """
    text, assign, access, hexes, candidates, base = (fresh(df, f"{spans}_{x}") for x in ("text", "assign", "access", "hex", "candidates", "base"))
    whole = F.col(text)
    found = df.withColumn(text, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    found = found.withColumns({k: F.regexp_extract_all(whole, F.lit(p), F.lit(0)) for k, p in ((assign, ASSIGN), (access, ACCESS), (hexes, HEX), (candidates, CANDIDATE))})
    values = F.filter(_positions(whole, ASSIGN, F.col(assign), "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= VALUE)
    found = found.withColumn(base, F.concat(values, _positions(whole, ACCESS, F.col(access), "access"), _positions(whole, HEX, F.col(hexes), "hex")))
    # Positions are found only where a candidate is suspicious.
    risky = F.when(F.exists(F.col(candidates), _suspicious), F.filter(_positions(whole, CANDIDATE, F.col(candidates), "entropy"), lambda s: _suspicious(s["value"])))
    order = F.array(*map(F.lit, KINDS))

    def rank(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).cast("int").alias("rank"), s["end"].alias("end"), s["value"].alias("value"))

    def uncovered(every: Column) -> Column:
        # In order of starts, a pattern's span covers what ends no later than the latest end so far.
        ends = _running(F.transform(every, lambda s: F.when(s["rank"] < len(KINDS), s["end"]).otherwise(0)), F.greatest)
        return _once(ends, lambda reach: F.filter(every, lambda s, i: (s["rank"] < len(KINDS)) | (F.get(reach, i) < s["end"])))

    every = F.sort_array(F.transform(F.concat(F.col(base), F.coalesce(risky, F.slice(F.col(base), 1, 0))), rank))
    shown = lambda s: F.struct(F.element_at(order, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    return found.withColumn(spans, F.transform(_once(every, uncovered), shown)).drop(text, assign, access, hexes, candidates, base)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` of every row, texts without secrets included; null and
    repeated ids are kept, other columns are not looked at, an empty table gives no rows."""
    return with_spans(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), "spans", text_col).select(id_col, "spans")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret in ``text_col`` replaced by ``mask``; spans that touch or
    overlap get one mask. Rows, and texts without secrets (null ones too), stay as they are."""
    spans, column = fresh(df, "spans"), F.col(f"`{text_col}`")

    def masked(reach: Column) -> Column:
        """``reach``: the latest end so far at each span, in order of starts."""
        place = F.sequence(F.lit(0), F.size(reach) - 1)
        begin = lambda i: F.get(F.col(spans), i)["start"]
        starts = F.transform(F.filter(place, lambda i: (i == 0) | (begin(i) > F.get(reach, i - 1))), begin)
        ends = F.transform(F.filter(place, lambda i: (i == F.size(reach) - 1) | (begin(i + 1) > F.get(reach, i))), lambda i: F.get(reach, i))
        edges = F.concat(F.array(F.lit(0)), F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b))), F.array(F.length(column)))
        parts = _once(edges, lambda own: _between(column, own))
        return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 1, F.lit(mask)).otherwise(part)), "")

    clean = _once(_running(F.col(f"{spans}.end"), F.greatest), masked)
    return with_spans(df, spans, text_col).withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(column)).select(*df.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of all ``documents``, and a digest of the base ones."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        count("entropy"),
    )


def _sql_spans(kind: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' as kind, {KINDS.index(kind)} as rank, hits[i] as value,
      coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) as start
    from (select doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) as i
          from (select doc_id, regexp_extract_all(text, '{p}') as hits, string_split_regex(text, '{p}') as gaps from docs) where len(hits) > 0)"""


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    # RE2 has no back-references: filler is spelt out.
    forms = [f for f in ALLOWED_FORMS if r"\1" not in f]
    filler = "|".join(f"{'[' + c + ']' if c == '+' else c}{{8}}" for c in ALPHABET)
    allowed = " or ".join([f"regexp_matches(value, {quote(f)})" for f in (*forms, filler)] + [f"lower(value) in ({', '.join(map(quote, ALLOWED_VALUES))})"])
    least = "case " + " ".join(f"when regexp_matches(value, {quote(p)}) then {b}" for p, b in CLASSES[:-1]) + f" else {CLASSES[-1][1]} end"
    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
base as (
  select * from ({_sql_spans("assign", ASSIGN)}) where length(regexp_extract(value, {quote(ASSIGN)}, 1)) >= {VALUE}
  union all {_sql_spans("access", ACCESS)}
  union all {_sql_spans("hex", HEX)}),
candidates as (select * from ({_sql_spans("entropy", CANDIDATE)}) where not ({allowed})),
windows as (
  select value, w, c, count(*) as n
  from (select value, w, unnest(string_split(substr(value, w, {WINDOW}), '')) as c
        from (select value, unnest(range(1, length(value) - {WINDOW} + 2)) as w from (select distinct value from candidates)))
  group by all),
entropy as (
  select value, max(h) as h from (select value, w, log2({WINDOW}.0) - sum(n * log2(n)) / {WINDOW}.0 as h from windows group by all) group by all),
extra as (
  select c.* from candidates c join entropy e using (value)
  where h >= {least} and not exists (select 1 from base b where b.doc_id = c.doc_id and b.start <= c.start and b.start + length(b.value) >= c.start + length(c.value))),
spans as (select doc_id, kind, rank, start, kind || ':' || cast(start as bigint) || ':' || cast(start + length(value) as bigint) as span from (from base union all from extra)),
sums as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, count(*) filter (kind = 'entropy') as n_entropy,
    string_agg(span, ',' order by start, rank) filter (kind <> 'entropy') as base, string_agg(span, ',' order by start, rank) as spans
  from spans group by doc_id)
select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, cast(coalesce(n_entropy, 0) as bigint) as n_entropy
from docs left join sums using (doc_id)"""


OP4_SQL = _sql()
