"""Secret scans by linking the parts of a credential; built-in column functions only.

Strong patterns (an assignment to a secret's name, an access identifier, a long hex run) are reported by themselves. Weak
parts (a login name, an unnamed mixed string, an endpoint) are reported only where complementary parts stand together
inside one scope (lines without a blank line between them), however far apart. The scope is the interval that parts are
joined on: each meets the roles that its scope holds, so work grows with the parts and not with their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.inline import before, blocks, bound

# Fixed values of the contract: the patterns of the three base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run, so the same as runs of at least 24
KINDS = ["assign", "access", "hex", "login", "string", "endpoint"]

# The method's own weak parts; the second group, if any, is the value.
LOGIN = r"""(?i:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
STRING = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{20})(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{20,}={0,2}"
ENDPOINT = r"""(?i:(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\x20\x09-\x0D"'<>]+|(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?)"""

BLANK = r"\n[\x20\x09-\x0D]*\n"
SPANS = "array<struct<start: int, kind: int, end: int>>"

# Which roles complete one another.
ROLES = {"assign": "secret", "string": "secret", "hex": "secret", "access": "identity", "login": "identity", "endpoint": "place"}


def spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches, in code points.

    The matches and the texts between them alternate, so places are running sums of their lengths, block by block.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _places(gaps, found, F.transform(found, lambda m: F.lit(True)), kind)


def _places(gaps: Column, found: Column, good: Column, kind: str) -> Column:
    lengths = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("match"), good.alias("good")),
                          lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("match"), x["good"].alias("good")))
    empty = F.expr(f"cast(array() as {SPANS})")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["match"]
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["good"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def inside(rows: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.transform(blocks(F.size(rows)), lambda b: F.aggregate(F.sequence(b["lo"], b["hi"]), start, lambda acc, i: add(acc, F.get(rows, i))))

    def moved(parts: Column) -> Column:
        begins = before(F.transform(parts, lambda b: b["at"]), F.lit(0), lambda now, x: now + x)
        return F.flatten(F.zip_with(parts, begins, lambda b, o: F.transform(b["out"], lambda s: F.struct(
            (s["start"] + o).alias("start"), s["kind"].alias("kind"), (s["end"] + o).alias("end")))))

    return bound(bound(lengths, inside), moved)


def _present(text: Column, pattern: str, value: Column) -> Column:
    """``value`` where the text has a match at all, so that most texts are searched once only."""
    return F.when(text.rlike(pattern), value).otherwise(F.expr(f"cast(array() as {SPANS})"))


def base_spans(text: Column) -> Column:
    """The base spans, by start, then kind as listed."""
    whole = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    long = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= 6)
    assign = _places(F.split(text, ASSIGN, -1), whole, long, "assign")
    access_found = F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))
    access = _places(F.split(text, ACCESS, -1), access_found, F.transform(access_found, lambda m: F.char_length(m) >= 20), "access")
    return F.array_sort(F.concat(_present(text, ASSIGN, assign), _present(text, ACCESS, access), _present(text, HEX, spans(text, HEX, "hex"))))


def weak_spans(text: Column) -> Column:
    return F.concat(*(_present(text, p, spans(text, p, k)) for p, k in ((LOGIN, "login"), (STRING, "string"), (ENDPOINT, "endpoint"))))


def _listed(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), kind + 1)


def linked(parts: DataFrame) -> DataFrame:
    """(key, more): the weak parts that a complementary part completes, unless a base span covers them.

    ``parts`` (key, scope_starts, spans) holds the parts of each distinct text. A secret is completed by any part of its
    scope that is none, the others by a secret of their scope. Scopes and covering spans are running values over the starts.
    """
    marks = F.transform("scope_starts", lambda p: F.struct(p.alias("start"), F.lit(-1).alias("kind"), p.alias("end")))
    so_far = Window.partitionBy("key").orderBy("s.start")  # what starts at the same place counts as well
    kind = F.col("s.kind")
    one = parts.select("key", F.explode(F.concat("spans", marks)).alias("s")).select(
        "key", "s", F.count_if(kind < 0).over(so_far).alias("scope"), F.max(F.when(kind.between(0, 2), F.col("s.end"))).over(so_far).alias("reach")).where(kind >= 0)
    one = one.withColumn("secret", _role(kind) == "secret")
    whole = one.groupBy("key", "scope").agg(F.max("secret").alias("secrets"), F.min("secret").alias("only")).where("secrets and not only")
    free = one.where((kind >= 3) & (F.coalesce("reach", F.lit(-1)) < F.col("s.end")))
    return free.join(whole, ["key", "scope"], "left_semi").groupBy("key").agg(F.collect_set("s").alias("more"))


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, base, spans): the ``keep`` columns as a struct, and array<struct<start, kind, end>> (kind by its place in ``KINDS``).

    Base spans stay in ``spans``; linked weak parts come on top unless a base span covers them. Equal texts are linked once,
    so copies neither pile up nor differ. A null text counts as empty and has none; rows may repeat.
    """
    keep = keep if keep is not None else docs.columns
    scanned = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body")).select(
        "row", "body", base_spans(F.col("body")).alias("base"), weak_spans(F.col("body")).alias("weak"))
    both = F.concat("base", "weak")
    roles = F.array_distinct(F.transform(both, lambda s: _role(s["kind"])))
    hopeful = (F.size("weak") > 0) & F.array_contains(roles, "secret") & (F.size(roles) > 1)
    # Texts without a chance to link get keys of their own, so that they are dealt evenly.
    keyed = scanned.withColumn("key", F.when(hopeful, F.sha2("body", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("row").cast("string"))))
    starts = F.transform(spans(F.col("body"), BLANK, "assign"), lambda s: s["end"])
    parts = keyed.where(hopeful).select("key", starts.alias("scope_starts"), both.alias("spans")).distinct()
    joined = keyed.select("row", "base", "key").join(linked(parts), "key", "left")
    extra = F.coalesce("more", F.expr(f"cast(array() as {SPANS})"))
    return joined.select("row", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs`` (doc_id, text)."""
    found = find_secrets(docs, keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("row.doc_id", *map(count, KINDS[:3]), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _marked(text: Column, spans_: Column, mark: str) -> Column:
    """The text with every span replaced; a block of spans works on its own stretch of the text."""
    def of(rows: Column) -> Column:
        ends = F.transform(blocks(F.size(rows)), lambda b: F.struct(
            b["lo"].alias("lo"), b["hi"].alias("hi"), F.aggregate(F.sequence(b["lo"], b["hi"]), F.lit(0), lambda m, i: F.greatest(m, F.get(rows, i)["end"])).alias("end")))
        return bound(ends, lambda parts: joined(rows, parts))

    def joined(rows: Column, parts: Column) -> Column:
        begins = before(F.transform(parts, lambda b: b["end"]), F.lit(0), lambda now, x: F.greatest(now, x))
        pieces = F.zip_with(parts, begins, lambda b, at: bound(F.substring(text, at + 1, F.greatest(b["end"] - at, F.lit(0))), lambda own: piece(rows, b, at, own)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(F.transform(parts, lambda b: b["end"])) + 1, F.char_length(text)))

    def piece(rows: Column, b: Column, first: Column, own: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            before_it = F.concat(acc["out"], F.substring(own, acc["at"] - first + 1, s["start"] - acc["at"]), F.lit(mark))
            return F.struct(F.when(s["start"] >= acc["at"], before_it).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        start = F.struct(F.lit("").alias("out"), first.alias("at"))
        return F.aggregate(F.sequence(b["lo"], b["hi"]), start, lambda acc, i: step(acc, F.get(rows, i)), lambda acc: acc["out"])

    return bound(spans_, of)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found replaced by ``mark``; all rows and columns stay, n_chars follows the text. Overlapping spans are one."""
    text = F.col("row.text")
    cleaned = _marked(text, F.col("spans"), mark)
    found = find_secrets(docs).withColumn("clean", F.when(F.size("spans") == 0, text).otherwise(cleaned))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.char_length("clean").cast(dict(docs.dtypes)["n_chars"]))
    return found.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
