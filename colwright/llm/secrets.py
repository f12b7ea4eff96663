"""Secret scans with linking of credential parts, in DataFrame functions only.

Base spans are strong by themselves: assignments to secret names, access identifiers, long
hexadecimal runs. Weak parts (login names, mixed random strings, endpoints) are reported
only where at most SCOPE code points lie between them and their complement: a weak identifier or
a weak secret needs a part of the other role, an endpoint needs both. Whether it does is
an interval join: parts meet the extremes of the complement's intervals in the cells of SCOPE
code points around them, so no pairs are made, however many or long the parts of a text are.

Positions are code points, ends exclusive. Null and empty texts have no spans. Equal texts
have equal links, so links are found once per distinct text, and copies cost no more
than one. Texts without weak parts to link, usually nearly all, are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colwright.columns import col, require
from colwright.llm.text import free_name, let, running, whole

SCOPE = 200
# Code points of the blocks from which pieces of a text are cut.
CUT = 1024
PLACEHOLDER = "[SECRET]"
# The three base patterns and the shortest lengths that count.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED_CHARS = 12
# Weak parts. A random string has capitals, small letters and digits, so it is no base span by itself.
WEAK_ACCESS = r"""\b(?i:user(?:_?name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
WEAK_SECRET = (
    r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{24})(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])"
    r"[A-Za-z0-9+/]{24,}={0,2}"
)
ENDPOINT = r"""\bhttps?://[^\s"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b"""
# kind: rank in reports, role in linking, weak or not, pattern.
KINDS = {
    "assign": (0, "secret", False, ASSIGN),
    "access": (1, "access", False, ACCESS),
    "hex": (2, "secret", False, HEX),
    "weak_access": (3, "access", True, WEAK_ACCESS),
    "weak_secret": (4, "secret", True, WEAK_SECRET),
    "endpoint": (5, "endpoint", True, ENDPOINT),
}
NEEDS = {"access": ["secret"], "secret": ["access"], "endpoint": ["access", "secret"]}
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def find(text: Column, kind: str) -> Column:
    """All spans of a kind: leftmost, not overlapping, in order.

    Hits and the pieces between them come from the same pattern; their lengths, added up, are the positions.
    """
    rank, _, _, pattern = KINDS[kind]
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")

    def fields(x: Column) -> Column:
        hit = F.length(x["hit"])
        good = F.length(F.regexp_extract(x["hit"], pattern, 2)) >= ASSIGNED_CHARS if kind == "assign" else F.lit(True)
        return F.struct((F.length(x["piece"]) + hit).alias("step"), hit.alias("chars"), good.alias("good"))

    def spans(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda x: x["step"]))
        made = F.zip_with(
            parts, ends,
            lambda x, end: F.struct((end - x["chars"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["good"].alias("good")),
        )
        kept = F.filter(made, lambda s: s["good"])
        return F.transform(kept, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"])).cast(f"array<{SPAN}>")

    # The piece behind the last hit has no hit and no span.
    parts = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    return F.when(text.rlike(pattern), let(F.transform(parts, fields), spans)).otherwise(none)


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, by start and then by rank of the kind, joined by commas."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _linked(parts: DataFrame, key: str, scope: int) -> DataFrame:
    """key, linked: of each text, the weak parts whose complement lies within the scope: no more than it between the end of one and the start of the other.

    A part stands in every cell that it covers. A weak part asks the cells from `scope` before it to `scope` behind it: in those in
    between any complement will do, in the first one it must end late enough, in the last one begin early enough. First and last are never one.
    """
    part = parts.select(key, F.explode("parts").alias("p")).select(key, "p.*")
    covered = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))).alias("near")
    cells = part.select(key, F.col("role").alias("needed"), covered, "start", "end").groupBy(key, "needed", "near").agg(
        F.min("start").alias("low"), F.max("end").alias("high")
    )
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    first, last = F.floor((F.col("start") - scope - 1) / scope), F.floor((F.col("end") + scope) / scope)
    weak = part.filter("weak").select(key, "start", "rank", "kind", "end", first.alias("first"), last.alias("last"), needs[F.col("role")].alias("needs"))
    asked = weak.select("*", F.explode("needs").alias("needed")).select("*", F.explode(F.sequence("first", "last")).alias("near"))
    met = asked.join(cells, [key, "needed", "near"]).filter(
        ((F.col("near") > F.col("first")) | (F.col("high") >= F.col("start") - scope))
        & ((F.col("near") < F.col("last")) | (F.col("low") <= F.col("end") + scope))
    )
    # The weak part itself is no complement: roles differ.
    whole_parts = met.groupBy(key, "start", "rank", "kind", "end").agg(
        F.count_distinct("needed").alias("met"), F.max(F.size("needs")).alias("needs")
    )
    span = F.struct("start", "rank", "kind", "end").cast(SPAN)
    return whole_parts.filter("met = needs").groupBy(key).agg(F.collect_list(span).alias("linked"))


def scan(df: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Append base_spans and spans, arrays of (start, rank, kind, end) in order; spans holds the linked ones too.

    The new columns replace columns of these names.
    """
    require(df, text)
    df = df.select(*[col(c) for c in df.columns if c.lower() not in ("base_spans", "spans")])
    body, weak, key = whole(text), free_name(df, "__weak"), free_name(df, "__text")
    base = F.array_sort(F.concat(*[find(body, k) for k, v in KINDS.items() if not v[2]]))

    # What cannot hold an identifier, a secret and a weak part is done with after the base patterns.
    def some(*kinds: str) -> Column:
        return body.rlike("|".join(f"(?:{KINDS[k][3]})" for k in kinds))

    may_link = some("access", "weak_access") & some("assign", "hex", "weak_secret")
    plain = df.filter(~may_link).withColumn("base_spans", base).withColumn("spans", F.col("base_spans"))
    rich = df.filter(may_link).withColumn("base_spans", base)
    rich = rich.withColumn(weak, F.concat(*[find(body, k) for k, v in KINDS.items() if v[2]])).withColumn(key, F.sha2(body, 256))

    roles = F.create_map(*[x for v in KINDS.values() for x in (F.lit(v[0]), F.lit(v[1]))])
    is_weak = [v[0] for v in KINDS.values() if v[2]]
    parts = rich.select(
        key,
        F.transform(
            F.concat("base_spans", weak),
            lambda s: F.struct(
                s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"),
                roles[s["rank"]].alias("role"), s["rank"].isin(is_weak).alias("weak"),
            ),
        ).alias("parts"),
    ).dropDuplicates([key])
    linked = free_name(rich, "linked")
    links = _linked(parts, key, scope).withColumnRenamed("linked", linked)
    joined = rich.join(links, key, "left").withColumn(
        "spans", F.array_sort(F.concat("base_spans", F.coalesce(linked, F.array().cast(f"array<{SPAN}>"))))
    )
    return plain.unionByName(joined.drop(key, weak, linked))


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace each span of the text, overlapping ones together, by a placeholder; null texts stay null."""
    body = col(text)
    ordered = F.array_sort(F.transform(col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def runs(spans: Column) -> Column:
        """Runs of overlapping spans: one opens where a span starts at or behind the highest end so far."""

        def of(reach: Column) -> Column:
            opens = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1)))

            def run(at: Column) -> Column:
                last = lambda k: F.coalesce(F.get(at, k + 1), F.size(spans)) - 1
                return F.transform(at, lambda i, k: F.struct(F.get(spans, i)["start"].alias("start"), F.get(reach, last(k)).alias("end")))

            return let(opens, run)

        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), of)

    def cut(blocks: Column, low: Column, high: Column) -> Column:
        """Code points from low to high: only the blocks that hold them are looked at."""
        first = F.floor(low / CUT).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor(high / CUT).cast("int") - first + 1), "")
        return near.substr(low - first * CUT + 1, high - low)

    def cleaned(found: Column, blocks: Column) -> Column:
        lows = F.concat(F.array(F.lit(0)), F.transform(found, lambda s: s["end"]))
        highs = F.concat(F.transform(found, lambda s: s["start"]), F.array(F.length(body)))
        return F.array_join(F.zip_with(lows, highs, lambda low, high: cut(blocks, low, high)), PLACEHOLDER)

    blocks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    clean = let(let(ordered, runs), lambda found: let(blocks, lambda b: cleaned(found, b)))
    return df.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body))
