"""Personal data by bootstrapped contextual extraction, with built-in functions only.

Seeds are the matches of four fixed expressions. Other tokens that look like identifiers (an at sign or five digits at least) and groups of
digits joined by spaces, brackets, dots or hyphens (five digits at least) are candidates. The words beside a seed or candidate are lexical patterns: the one before, the one after, and both. In the graph of
patterns and instances (distinct values), a pattern's confidence for a kind is the mean score of its instances, with one doubtful instance added;
a candidate's score is that of "at least one of its confident patterns is right"; seeds have score 1. Every round takes its patterns anew from the
seeds and the candidates accepted so far (score ``ACCEPT`` or more), until a round accepts nothing new (or after ``ROUNDS``). Accepted candidates are personal data of that kind
wherever they stand; where they overlap, the longest. Everything is counted over all documents; frequent patterns and values meet their scores by a bounded broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import RUN, bind, running_greatest, running_totals, table
from sparkloom.operators.graph import hot_values, lookup
from sparkloom.session import cut

#: Kinds in the order of their spans, and their expressions. Beside the fixed expressions they have possessive repeats and looks
#: behind, which change no match: a match never begins within a run that its first part could have begun earlier.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
GATES = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
TOKEN = r"(?:\G|(?<![A-Za-z0-9._%+@-]))[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+"
GROUP = r"(?:\G|(?<![A-Za-z0-9]))\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++"
#: A neighbouring word: letters and digits, or one other character that is no space. It is looked for in CONTEXT characters first, and without a bound where it fills these.
WORD, CONTEXT = r"(?:[\p{L}\p{N}]++|[^\s\p{L}\p{N}])", 40
ROUNDS, CONFIDENT, ACCEPT = 20, 0.7, 0.9
#: Most accepted spans that go to every worker when they are put back beside their texts; more meet them in a shuffled join.
SENT_BACK = 200_000
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _last_word(text: Column) -> Column:
    """The word that a text ends with, however long it is; spaces behind it do not count."""
    near = F.right(text, F.lit(CONTEXT))
    found = lambda x: F.regexp_extract(x, rf"(?<![\p{{L}}\p{{N}}])({WORD})\s*+$", 1)
    return F.when(F.length(text) <= CONTEXT, found(text)).when(near.rlike(rf"^[\p{{L}}\p{{N}}]*+\s*+$"), found(text)).otherwise(found(near))


def _matches(text: Column, expression: str) -> Column:
    """Leftmost matches that don't overlap, with their places in code points and the words beside them; time is near proportional to the text."""
    chunk = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?{expression}"), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?({expression})"), F.lit(1))
    after = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?{expression}(?=\s*+({WORD}?+))"), F.lit(1))

    def span(x: Column, n: Column) -> Column:
        end = (n + F.length(x["c"])).cast("int")
        before = F.left(x["c"], F.length(x["c"]) - F.length(x["v"]))
        return F.struct((end - F.length(x["v"])).alias("start"), end.alias("end"), x["v"].alias("value"), _last_word(before).alias("before"), x["a"].alias("after"))

    return bind(F.arrays_zip(chunk.alias("c"), value.alias("v"), after.alias("a")), lambda z: F.zip_with(z, running_totals(F.transform(z, lambda x: F.length(x["c"]))), span))


FAR = 2**31


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of the base, in time near proportional to their number."""
    one = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
    ordered = F.array_sort(F.concat(F.transform(base, one(0)), F.transform(spans, one(1))))
    ends = lambda o: running_greatest(F.transform(o, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(-1)))
    starts = lambda o: F.reverse(running_greatest(F.reverse(F.transform(o, lambda x: F.when(x["kind"] == 0, F.lit(FAR) - x["start"]).otherwise(F.lit(-1).cast("bigint"))))))
    free = lambda z: F.filter(z, lambda x: (x["o"]["kind"] == 1) & (x["e"] <= x["o"]["start"]) & ((x["s"] < 0) | (F.lit(FAR) - x["s"] >= x["o"]["end"])))
    own = lambda x: F.struct(*[x["o"][c].alias(c) for c in ("start", "end", "value", "before", "after")])
    return bind(ordered, lambda o: F.transform(free(F.arrays_zip(o.alias("o"), ends(o).alias("e"), starts(o).alias("s"))), own))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.try_add((d.cast("int") * 2 / 10).cast("int"), d.cast("int") * 2 % 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind, value, before, after), sorted: the valid matches of all kinds."""
    def of(kind: str, rank: int) -> Column:
        found = F.filter(_matches(text, KINDS[kind]), lambda m: _valid(kind, m["value"]))
        made = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))
        return F.when(text.rlike(GATES[kind]), made).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>>"))

    return F.array_sort(F.concat(*(of(kind, rank) for rank, kind in enumerate(KINDS))))


def _patterns(x: Column) -> Column:
    """The patterns of a seed or candidate: the words beside it in lower case, digits as zeros, if there are any."""
    left, right = (F.regexp_replace(F.lower(x[side]), r"[0-9]", "0") for side in ("before", "after"))
    one = F.when(left != "", F.concat(F.lit("L "), left))
    two = F.when(right != "", F.concat(F.lit("R "), right))
    both = F.when((left != "") & (right != ""), F.concat(F.lit("B "), left, F.lit(" "), right))
    return F.array_compact(F.array(one, two, both))


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _found(rows: DataFrame, whole: bool) -> DataFrame:
    """(head, base, spans) of rows (head, body), a row for each, with whole also body; body is a text without nulls."""
    body, kept = F.col("body"), ["head", "body"] if whole else ["head"]
    rows = rows.withColumn("base", base_spans(body))
    tokens = F.filter(_matches(body, TOKEN), lambda m: (F.length(_digits(m["value"])) >= 5) | F.contains(m["value"], F.lit("@")))
    joined = F.filter(_matches(body, GROUP), lambda m: (F.length(_digits(m["value"])) >= 5) & m["value"].rlike(r"[\x20()]"))
    joined = F.when(body.rlike(r"[0-9][\x20().-]{1,3}[0-9]"), joined).otherwise(F.array().cast(SPAN))
    rows = rows.withColumn("free", F.when(body.rlike("[0-9@]"), _apart(F.concat(tokens, joined), F.col("base"))).otherwise(F.array().cast(SPAN)))
    seed = F.transform("base", lambda b: F.struct(F.lower(b["value"]).alias("instance"), b["kind"].alias("kind"), _patterns(b).alias("patterns")))
    other = F.transform("free", lambda m: F.struct(F.lower(m["value"]).alias("instance"), F.lit(None).cast("string").alias("kind"), _patterns(m).alias("patterns")))
    plain = F.transform("base", lambda b: F.struct(*[b[c].alias(c) for c in ("start", "rank", "end", "kind", "value")]))
    open_ = F.transform("free", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    found = cut(rows.select(F.monotonically_increasing_id().alias("row"), *kept, plain.alias("base"), F.concat(seed, other).alias("seen"), open_.alias("free")))

    edges = found.select(F.explode("seen").alias("s")).select(F.col("s.instance").alias("instance"), F.col("s.kind").alias("kind"), F.explode("s.patterns").alias("pattern"))
    edges = cut(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))  # a value that is a seed somewhere is one
    accepted = cut(_bootstrap(edges))
    free = found.where("size(free) > 0").select("row", F.explode("free").alias("f")).withColumn("instance", F.lower("f.value"))
    extra = lookup(free, accepted, "instance").groupBy("row").agg(F.collect_list(F.struct(F.col("f.start").alias("start"), F.col("rank"), F.col("f.end").alias("end"), F.col("kind"), F.col("f.value").alias("value"))).alias("extra"))
    longest = F.filter("extra", lambda m: ~F.exists("extra", lambda x: (x["start"] < m["end"]) & (x["end"] > m["start"]) & (x["end"] - x["start"] > m["end"] - m["start"])))
    extra = cut(extra.select("row", longest.alias("extra")))
    few = extra.agg(F.coalesce(F.sum(F.size("extra") + 1), F.lit(0))).first()[0] <= SENT_BACK
    out = found.select("row", *kept, "base").join(F.broadcast(extra) if few else extra, "row", "left")
    return out.select(*kept, "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(SPANS)))).alias("spans"))


def extract(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all of df's without it), base and spans: arrays of (start, rank, end, kind, value), sorted by start and rank.

    Places are code points, ends exclusive. base: the valid matches of the fixed expressions; spans: those and the accepted candidates that overlap none
    of them. A null text counts as empty and has no spans. Repeated rows each get their own spans (and count once as evidence, as instances are distinct values);
    an empty table gives an empty one; columns base and spans of df are replaced, and no other name clashes. Ties: a candidate of two kinds takes that of the higher score,
    then the first. A text of any length is searched whole.
    """
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("base", "spans")]
    head = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.lit(0).alias("none"))
    found = _found(df.select(head.alias("head"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body")), False)
    return found.select(*[F.col(f"head.c{i}").alias(c) for i, c in enumerate(names)], "base", "spans")


def _bootstrap(edges: DataFrame) -> DataFrame:
    """(instance, kind, rank) of the candidates that the graph's rounds accept. edges: distinct (pattern, instance), kind null for candidates.

    Patterns that can't be confident even if all their instances were right (fewer than three) are left out, which changes nothing.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= CONFIDENT * (F.col("n") + 1))
    rows = cut(lookup(edges, sizes, "pattern"))
    seeds = cut(rows.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.first("n").alias("n"), F.count("*").cast("double").alias("mass")))
    free = cut(rows.where("kind IS NULL").select("pattern", "instance", "n"))
    hot = {c: hot_values(free, c) for c in ("pattern", "instance")}
    scores, before = None, -1
    for _ in range(ROUNDS):
        known = seeds.withColumn("sure", F.lit(True))
        if scores is not None:  # patterns of accepted candidates are new ones; the others' scores count in either
            more = lookup(free, scores, "instance", hot["instance"]).groupBy("pattern", "kind").agg(F.first("n").alias("n"), F.sum("score").alias("mass"), F.max(F.round("score", 9) >= ACCEPT).alias("sure"))
            known = known.unionByName(more).groupBy("pattern", "kind").agg(F.first("n").alias("n"), F.sum("mass").alias("mass"), F.max("sure").alias("sure")).where("sure")
        sure = known.withColumn("confidence", F.col("mass") / (F.col("n") + 1)).where(F.col("confidence") >= CONFIDENT)
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        scores = cut(lookup(free, cut(sure.select("pattern", "kind", "confidence")), "pattern", hot["pattern"]).groupBy("instance", "kind").agg((1 - wrong).alias("score")))
        now = scores.where(F.round("score", 9) >= ACCEPT).count()
        if now == before:
            break
        before = now
    rank = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)]), F.col("kind"))
    ranked = scores.where(F.round("score", 9) >= ACCEPT).withColumn("rank", rank)
    best = ranked.groupBy("instance").agg(F.max_by(F.struct("kind", "rank"), F.struct(F.round("score", 9), -F.col("rank"))).alias("b"))
    return best.select("instance", "b.kind", "b.rank")


def _redacted(body: Column, spans: Column) -> Column:
    """A text with its sorted spans replaced by kinds; overlapping spans as one, by the first one's kind.

    Spans go by RUN at a time: each run's part of the text is taken once, and its pieces are taken from that part.
    """
    last = lambda o: running_greatest(F.transform(o, lambda x: x["end"]))
    first = lambda o: F.filter(F.arrays_zip(o.alias("o"), last(o).alias("e")), lambda x: x["o"]["start"] >= x["e"])
    # where a span begins that overlaps none before it, the text goes on from the greatest end so far
    marks = lambda o: F.transform(first(o), lambda x: F.struct(F.greatest(x["e"], F.lit(0)).cast("int").alias("a"), x["o"]["start"].alias("b"), x["o"]["kind"].alias("k")))
    runs = lambda m: F.transform(F.sequence(F.lit(0), ((F.size(m) - 1) / RUN).cast("int")), lambda i: F.slice(m, i * RUN + 1, RUN))
    cut_ = lambda t, a, b: F.substr(t, a + 1, b - a)

    def one(run: Column) -> Column:
        begin, end = F.element_at(run, 1)["a"], F.element_at(run, -1)["b"]
        return bind(cut_(body, begin, end), lambda part: F.array_join(F.transform(run, lambda x: F.concat(cut_(part, x["a"] - begin, x["b"] - begin), F.lit("<"), x["k"], F.lit(">"))), ""))

    tail = F.substr(body, F.array_max(F.transform(spans, lambda x: x["end"])) + 1)
    return F.when(F.size(spans) > 0, F.concat(bind(spans, lambda o: bind(marks(o), lambda m: F.array_join(F.transform(runs(m), one), ""))), tail)).otherwise(body)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of personal data replaced by its kind in angle brackets; overlapping spans are replaced as one, by the first one's kind.

    Null texts stay null, and texts without spans stay as they are. Repeated rows are changed alike; an empty table gives an empty one; no column name clashes.
    """
    others = [c for c in df.columns if c != text]
    head = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{text}`").isNull().alias("none"))
    found = _found(df.select(head.alias("head"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body")), True)
    clean = F.when(~F.col("head.none"), _redacted(F.col("body"), F.col("spans")))
    return found.select(*[clean.alias(c) if c == text else F.col(f"head.c{others.index(c)}").alias(c) for c in df.columns])


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    out = extract(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    of = lambda kind: F.filter("base", lambda b: b["kind"] == kind)
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
