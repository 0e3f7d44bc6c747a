"""Personal data in texts (operator 2), by DataFrame functions alone.

Four base expressions find e-mail addresses, IPv4 addresses, payment cards and telephone
numbers. These seed a bootstrap. Every token with a digit or an @ is an instance, and so is
every longest run of numbers joined by blanks, brackets, dots or hyphens outside of base
spans; the two words before it, the one before and the one after are lexical patterns of
the kind. Patterns and instances form a graph
whose edges are counted over the whole corpus. A pattern's confidence is the weighted
share of its instances that are trusted, an instance's trust is what its patterns leave
no doubt of; both are worked out in turn for some rounds. Patterns of high confidence
then make spans of instances no base expression knows.

Defined results: a null text is empty and has no spans; base spans of one kind never
overlap and failing matches are dropped without another try; spans of several kinds
may share text; found spans never touch base spans, and of overlapping ones the first and
longest stays; an instance without a word beside it has no pattern; words of any length are context;
repeated rows are each annotated and count as often; an empty table has no patterns and no rows;
columns other than id and text are kept by `redact` and ignored by `annotate`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, scan, starts
from .common import Scratch, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The contract's expressions; possessive where nothing could be given back, so that long runs cost no stack.
#: An e-mail address starts where a run of its letters does, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
HINTS = {"email": "@", "ip": None, "card": None, "phone": "+"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Numbers joined by blanks and the like, up to the end of the last one's token.
RUN = r"(?<!\S)[\[\"'<]*+[+(]*+[0-9]++(?:[\x20().-]++[0-9]++)++(?![^\s.,;:!?)\]\"'>])"
#: Rounds of the bootstrap, least confidence of a pattern, and least trusted instances it needs.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    def step(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        y = F.when(i % 2 == 0, x * 2).otherwise(x)
        return total + y - F.when(y > 9, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            n = F.regexp_replace(part, "^0+", "")
            return F.when(F.length(n) <= 3, F.concat(F.lit("0"), F.substring(n, 1, 3)).cast("int") <= 255).otherwise(F.lit(False))
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 12) & (n <= 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


SPAN = "struct<start:int,ord:int,end:int,kind:string>"
MATCH = "struct<start:int,end:int,m:string,before:string,after:string>"
#: The last two words of a text with the white space after them, and what stands after that.
TAIL = r"(?<!\S)(?:\S++\s++){0,2}+\S*+\z"
#: The first word of a text after what is left of the word before.
HEAD = r"\A\S*+\s++\S++"
MENTION = "struct<start:int,ord:int,end:int,instance:string,kind:string,before:string,after:string,seed:boolean>"
CUT = "struct<`from`:int,`to`:int,i:int>"
#: Characters in a page of a text; places are looked up within pages.
PAGE = 2048


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """array<MATCH> of an expression's matches: the texts between them give the places. With
    context, the two words before a match and the one after it, as far as the two matches
    before it and the one after it reach."""
    empty = F.expr(f"cast(array() as array<{MATCH}>)")
    none = F.lit("")

    def near(parts: Column, i: Column) -> Column:
        return F.coalesce(F.get(parts, i), none)

    def walk(t: Column, found: Column) -> Column:
        def placed(between: Column, at: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(at, i)
                before = after = none
                if context:
                    before = F.regexp_extract(F.concat(near(found, i - 2), near(between, i - 1), near(found, i - 1), near(between, i)), TAIL, 0)
                    after = F.regexp_extract(F.concat(near(between, i + 1), near(found, i + 1)), HEAD, 0)
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), before.alias("before"), after.alias("after"))

            return F.transform(found, one)

        return F.when(F.size(found) > 0, let(F.split(t, pattern), lambda b: let(starts(b, found), lambda at: placed(b, at)))).otherwise(empty)

    return let(text, lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: walk(t, found)))


def _of_kind(found: Column, order: int, kind: str) -> Column:
    valid = F.filter(found, lambda x: _valid(kind, x["m"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def base_spans(text: Column) -> Column:
    """array<SPAN> of all kinds, by start and then kind."""
    digit = text.rlike("[0-9@]")
    parts = []
    for k, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else digit
        none = F.expr(f"cast(array() as array<{MATCH}>)")
        parts.append(_of_kind(F.when(hint, matches(text, PATTERNS[kind])).otherwise(none), k, kind))
    return F.when(digit, F.array_sort(F.concat(*parts))).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _loose_kind(m: Column) -> Column:
    """The kind an unknown token could be of, by its shape."""
    n = F.length(_digits(m))
    return (
        F.when(m.rlike(r"^[^@\s]+@[^@\s]+$"), "email")
        .when(m.rlike(r"^[0-9]+([.:,][0-9]+){3}$"), "ip")
        .when((n >= 12) & (n <= 19) & m.rlike(r"^[0-9][0-9\x20._/-]*[0-9]$"), "card")
        .when((n >= 7) & (n <= 15) & m.rlike(r"^[+(]*[0-9][0-9()\x20._/-]*[0-9]$"), "phone")
    )


def _patterns(before: Column, after: Column) -> Column:
    """The two words before, the one before and the one after, as far as they are there."""
    two = F.regexp_replace(F.regexp_extract(before, r"(?:^|\s)(\S+\s+\S+)\s+$", 1), r"\s+", " ")
    one = F.regexp_extract(before, r"(?:^|\s)(\S+)\s+$", 1)
    next_ = F.regexp_extract(after, r"^[^\p{L}\p{N}\s]*\s+(\S+)", 1)
    return F.array_compact(F.array(*[F.when(w != "", F.concat(F.lit(place), F.lower(w))) for place, w in (("2<", two), ("1<", one), ("1>", next_))]))


def _over(kind: str) -> Callable[[Column], Column]:
    def over(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: F.when(_valid(kind, m), F.repeat(F.lit("x"), F.length(m))).otherwise(m))
        joined = F.array_join(F.zip_with(F.split(text, PATTERNS[kind]), found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
        return F.when(F.contains(text, F.lit(HINTS[kind])), joined).otherwise(text) if HINTS[kind] else joined

    return over


def _masked(text: Column) -> Column:
    """The text with base spans written over by letters, kind by kind."""
    for kind in KINDS:
        text = let(text, _over(kind))
    return text


def _beside(found: Column, base: Column) -> Column:
    """array<MENTION> of the matches, without the signs around them, that have some kind's
    shape and share no text with a base span. Both stand in order and no two matches
    overlap, so one walk along both tells."""

    def core(x: Column) -> Column:
        def cut(rest: Column) -> Column:
            def place(said: Column) -> Column:
                start = (x["start"] + F.length(x["m"]) - F.length(rest)).cast("int")
                return F.struct(start.alias("start"), F.lit(1).alias("ord"), (start + F.length(said)).cast("int").alias("end"), said.alias("instance"), _loose_kind(said).alias("kind"), x["before"].alias("before"), x["after"].alias("after"), F.lit(False).alias("seed"))

            return let(F.regexp_replace(rest, r"[^\p{L}\p{N}]+$", ""), place)

        return let(F.regexp_replace(x["m"], r"^[^\p{L}\p{N}+(]+", ""), cut)

    def walk(cores: Column) -> Column:
        event = lambda x, order, i: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), i.alias("i"))
        end = F.lit(2**31 - 1)
        events = F.concat(F.transform(base, lambda x, i: event(x, 0, i)), F.transform(cores, lambda x, i: event(x, 1, i)))
        last = F.array(F.struct(end.alias("start"), F.lit(1).alias("ord"), end.alias("end"), F.lit(-1).alias("i")))
        start = F.struct(F.lit(0).alias("reach"), F.lit(-1).alias("free"), F.lit(0).alias("end"))
        return F.transform(scan(F.concat(F.array_sort(events), last), start, step, "int"), lambda i: F.get(cores, i))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        # free: the number of the match at hand while no span is known to touch it, else -1
        is_match = x["ord"] == 1
        reach = F.when(is_match, s["reach"]).otherwise(F.greatest(s["reach"], x["end"]))
        free = F.when(is_match, F.when(s["reach"] <= x["start"], x["i"]).otherwise(-1)).otherwise(F.when(x["start"] >= s["end"], s["free"]).otherwise(-1))
        state = F.struct(reach.alias("reach"), free.alias("free"), F.when(is_match, x["end"]).otherwise(s["end"]).alias("end"))
        return state, F.filter(F.array(F.when(is_match, s["free"]).otherwise(-1)), lambda i: i >= 0)

    return let(F.filter(F.transform(found, core), lambda x: x["kind"].isNotNull() & (x["instance"] != "")), walk)


def _known(kind: str) -> Column:
    """array<MENTION> of a kind's base spans."""

    def one(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(0).alias("ord"), x["end"].alias("end"), x["m"].alias("instance"), F.lit(kind).alias("kind"), x["before"].alias("before"), x["after"].alias("after"), F.lit(True).alias("seed"))

    found = F.transform(F.filter(matches(F.col("text"), PATTERNS[kind], context=True), lambda x: _valid(kind, x["m"])), one)
    return F.when(F.exists("base", lambda s: s["kind"] == kind), found).otherwise(F.expr(f"cast(array() as array<{MENTION}>)"))


def _mentions(rows: DataFrame) -> DataFrame:
    """(rid, start, end, instance, pattern, kind, seed): base spans, and other tokens with a
    digit or @ and runs of numbers whose shape could be of some kind."""
    text, base = F.col("text"), F.col("base")
    part = text.rlike(r"[0-9][().-]*\x20[\x20().-]*[0-9]")
    masked = F.when(~part, F.lit("")).when(F.size(base) > 0, _masked(text)).otherwise(text)
    runs = F.filter(matches(masked, RUN, context=True), lambda x: F.contains(x["m"], F.lit(" ")))
    every = F.concat(*[_known(kind) for kind in KINDS], _beside(matches(text, TOKEN, context=True), base), _beside(runs, base))
    x = rows.where(text.rlike("[0-9@]")).select("rid", F.explode(every).alias("x"))
    x = x.select("rid", *[F.col(f"x.{c}").alias(c) for c in ("start", "end", "instance", "kind", "seed")], F.explode(_patterns(F.col("x.before"), F.col("x.after"))).alias("pattern"))
    return x.select("rid", "start", "end", "instance", "pattern", "kind", "seed")


def bootstrap(mentions: DataFrame, scratch: Scratch, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(kind, pattern, conf) of the patterns to be trusted."""
    edges = scratch.cut(mentions.groupBy("kind", "pattern", "instance").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max(F.col("seed").cast("double")).alias("trust")), "edges")
    trust = edges.groupBy("kind", "instance").agg(F.max("trust").alias("trust"))
    patterns = None
    for _ in range(rounds):
        scored = edges.drop("trust").join(trust, ["kind", "instance"])
        patterns = scored.groupBy("kind", "pattern").agg((F.sum(F.col("trust")) / F.count(F.lit(1))).alias("conf"), F.sum((F.col("trust") >= 0.5).cast("int")).alias("known"))
        patterns = scratch.cut(patterns.where((F.col("known") >= support) & (F.col("conf") >= confidence)), "patterns")
        doubt = edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6))))).alias("doubt"))
        seeds = edges.groupBy("kind", "instance").agg(F.max("trust").alias("seed"))
        trust = scratch.cut(seeds.join(doubt, ["kind", "instance"], "left").select("kind", "instance", F.greatest("seed", 1 - F.coalesce("doubt", F.lit(1.0))).alias("trust")), "trust")
    return patterns


def _annotated(docs: DataFrame, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows as written, with rid, text and base spans; and (rid, extra) of found spans."""
    text = text_or_empty(text_col)
    rows = scratch.cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text")).select(F.monotonically_increasing_id().alias("rid"), "row", "text", base_spans(F.col("text")).alias("base")), "rows")
    mentions = scratch.cut(_mentions(rows), "mentions")
    good = bootstrap(mentions, scratch)
    found = mentions.where("not seed").join(good, ["kind", "pattern"])
    order = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    spans = found.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", (-F.col("end")).alias("back"), order[F.col("kind")].alias("ord"), "end", "kind"))).alias("spans"))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        keep = (x["start"] >= s["end"]) | (x["start"] == s["start"]) & (x["end"] == s["end"])
        return F.when(keep, F.struct(x["start"].alias("start"), x["end"].alias("end"))).otherwise(s), F.filter(F.array(F.when(keep, x["i"]).otherwise(-1)), lambda i: i >= 0)

    def chosen(all_: Column) -> Column:
        places = F.transform(all_, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i")))
        kept = scan(places, F.struct(F.lit(-1).alias("start"), F.lit(0).alias("end")), step, "int")
        return F.transform(kept, lambda i: F.struct(F.get(all_, i)["start"].alias("start"), F.get(all_, i)["ord"].alias("ord"), F.get(all_, i)["end"].alias("end"), F.get(all_, i)["kind"].alias("kind")))

    extra = spans.select("rid", let(F.col("spans"), chosen).alias("extra"))
    return rows, extra


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per document; counts are of base spans."""
    scratch = Scratch(docs.sparkSession, "pii")
    slim = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_or_empty(text_col).alias(text_col))
    rows, extra = _annotated(slim, text_col, scratch)
    joined = rows.select("rid", F.col(f"row.{id_col}").alias(id_col), "base").join(extra, "rid", "left")
    every = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))
    counts = [_count("base", k).alias(f"n_{k}") for k in KINDS]
    return joined.select(id_col, *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows as they were, each span's text replaced by its kind in angle brackets."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows, extra = _annotated(docs, text_col, scratch)
    joined = rows.join(extra, "rid", "left")
    every = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))
    text = F.col("text")

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        # a span that starts within the one before it is covered by that one's mark
        one = F.struct(s["at"].alias("from"), x["start"].alias("to"), x["i"].alias("i"))
        fresh = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at")), F.when(fresh, F.array(one)).otherwise(F.expr(f"cast(array() as array<{CUT}>)"))

    def cut(pages: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PAGE).cast("int")
        near = F.array_join(F.slice(pages, first + 1, F.floor((b + PAGE - 1) / PAGE).cast("int") - first), "")
        return F.when(a < b, F.substring(near, a - first * PAGE + 1, b - a)).otherwise("")

    def written_over(spans: Column, pages: Column) -> Column:
        places = F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i")))
        parts = scan(places, F.struct(F.lit(0).alias("at")), step, CUT)
        kept = F.transform(parts, lambda x: F.concat(cut(pages, x["from"], x["to"]), F.lit("<"), F.upper(F.get(spans, x["i"])["kind"]), F.lit(">")))
        return F.concat(F.array_join(kept, ""), cut(pages, F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text)))

    pages = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0))
    clean = F.when(F.size("spans") > 0, let(pages, lambda p: written_over(F.col("spans"), p))).otherwise(F.col(f"row.`{text_col}`"))
    joined = joined.select("row", "text", every.alias("spans"))
    return joined.select(*[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
