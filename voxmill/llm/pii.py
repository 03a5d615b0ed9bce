"""Personal data by bootstrapped contextual extraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm._common import materialize, scratch, unused, with_row_key

KINDS = ("email", "ip", "card", "phone")

# Each pattern matches what the plain one does, leftmost and whole, in time linear in the text:
# runs are possessive, and a run is entered at its start or where the last match ended.
_WS = r"\x20\x09-\x0D"
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
#: A word with a digit or an at sign, of six characters or more.
_TOKEN = rf"(?<![^{_WS}])(?=[^{_WS}]{{6}})[^{_WS}0-9@]*+[0-9@][^{_WS}]*+"
#: Groups of digits with spaces, dots, dashes and brackets between them, none glued to a letter.
_RUN = r"(?<![\p{L}0-9_@%./+-])\+?+(?:\((?=[0-9]{1,5}\)))?+[0-9]++(?![\p{L}_@%])(?:[\x20().-]++[0-9]++(?![\p{L}_@%]))*+"
#: A cue glued to what it announces, as in tel:5551234567 or mail=bob@localhost.
_CUE = r"^[^0-9@:=]*+[:=][\"'(\[]*+(?!/)"

_SPAN = "array<struct<s:bigint,k:int,e:bigint,v:string>>"
#: A match with 80 code points of the text before it and 40 of the text after it.
_MATCH = "struct<s:bigint,k:int,e:bigint,v:string,b:string,a:string>"
_BEFORE, _AFTER = 80, 40


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(items: Column, state: Column, step, kind: str) -> Column:
    """A fold that also collects: ``step(state, x)`` gives the next state and an element, null for none.

    Elements are collected 256 at a time, so time stays in proportion to an array's length
    (an aggregate that appends to one array copies it at every element). Returns a struct of
    ``st``, the last state, and ``out``, an array of ``kind``.
    """
    none, size = F.array().cast(f"array<{kind}>"), 256

    def add(acc, x):
        after, new = step(acc["st"], x)
        return F.struct(after.alias("st"), F.when(new.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(new))).alias("out"))

    def chunk(acc, part):
        now = F.aggregate(part, F.struct(acc["now"]["st"].alias("st"), none.alias("out")), add)
        return F.struct(now.alias("now"), F.concat(acc["done"], F.array(acc["now"]["out"])).alias("done"))

    def parts(x):
        last = F.floor((F.size(x) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(x, i * size + 1, F.lit(size)))

    start = F.struct(F.struct(state.alias("st"), none.alias("out")).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.aggregate(_once(items, parts), start, chunk, lambda acc: F.struct(acc["now"]["st"].alias("st"), F.concat(F.flatten(acc["done"]), acc["now"]["out"]).alias("out")))


def _spans(text: Column, pattern: str, kind: int, ok=None) -> Column:
    """Matches of ``pattern`` in code points with what stands around them, those that fail ``ok`` dropped."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def beside(x):  # each match with what is between it and the next ones
        found, between, n = x["found"], x["between"], F.size(x["found"])
        zipped = F.arrays_zip(found, F.slice(between, F.lit(1), n), F.slice(between, F.lit(2), n), F.slice(found, F.lit(2), n), F.slice(between, F.lit(3), n))
        return zipped.cast("array<struct<m:string,g:string,g1:string,m1:string,g2:string>>")

    rows = _once(both, beside)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("tail"))

    def step(st, p):
        s = st["at"] + F.length(p["g"])
        e, before = s + F.length(p["m"]), F.right(F.concat(st["tail"], p["g"]), F.lit(_BEFORE))
        after = F.left(F.concat(*[F.left(F.coalesce(p[c], F.lit("")), F.lit(_AFTER)) for c in ("g1", "m1", "g2")]), F.lit(_AFTER))
        span = F.struct(s.cast("bigint").alias("s"), F.lit(kind).alias("k"), e.cast("bigint").alias("e"), p["m"].alias("v"), before.alias("b"), after.alias("a"))
        tail = F.right(F.concat(st["tail"], p["g"], p["m"]), F.lit(_BEFORE))
        return F.struct(e.cast("bigint").alias("at"), tail.alias("tail")), F.when(ok(p["m"]), span) if ok else span

    return F.when(F.rlike(text, F.lit(pattern)), _running(rows, start, step, _MATCH)["out"]).otherwise(F.array().cast(f"array<{_MATCH}>"))


def base_spans(text: Column) -> list[Column]:
    """Spans of the four base kinds, an array each."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    return [
        _spans(text, _EMAIL, 0),
        _spans(text, _IP, 1, lambda v: F.rlike(v, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))),
        _spans(text, _CARD, 2, lambda v: F.length(digits(v)).between(12, 19) & F.call_function("luhn_check", digits(v))),
        _spans(text, _PHONE, 3, lambda v: F.length(digits(v)).between(9, 15)),
    ]


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns around a span: the word before, two words before, the words before and after."""
    norm = lambda w: F.regexp_replace(F.lower(w), "[0-9]", "0")
    words = F.split(F.rtrim(before), rf"[{_WS}]+")
    one = norm(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))
    two = norm(F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit("")))
    nxt = norm(F.coalesce(F.try_element_at(F.split(F.ltrim(after), rf"[{_WS}]+"), F.lit(1)), F.lit("")))
    return F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two, F.lit(" "), one), F.concat(F.lit("3 "), one, F.lit(" _ "), nxt))


def _free(tokens: Column, base: Column) -> Column:
    """Those of ``tokens`` that overlap no span of ``base``: a pass for spans that begin before them, one backwards for later ones."""
    struct = lambda x, own: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v"), x["b"].alias("b"), x["a"].alias("a"))
    kind = "struct<s:bigint,own:int,k:int,e:bigint,v:string,b:string,a:string>"
    both = F.sort_array(F.concat(F.transform(base, lambda x: struct(x, 0)), F.transform(tokens, lambda x: struct(x, 1))))
    forth = _running(both, F.lit(-1).cast("bigint"), lambda st, x: (F.when(x["own"] == 0, F.greatest(st, x["e"])).otherwise(st), F.when((x["own"] == 0) | (st <= x["s"]), x)), kind)["out"]
    most = F.lit(2**62).cast("bigint")
    back = _running(F.reverse(forth), most, lambda st, x: (F.when(x["own"] == 0, F.least(st, x["s"])).otherwise(st), F.when((x["own"] == 1) & (st >= x["e"]), x)), kind)["out"]
    bare = F.transform(back, lambda x: F.struct(*[x[c].alias(c) for c in ("s", "k", "e", "v", "b", "a")]))
    return F.when(F.size(base) == 0, tokens).when(F.size(tokens) == 0, tokens).otherwise(bare)


def scan(docs: DataFrame, rid: str) -> DataFrame:
    """One row per document: rid, doc_id, base spans, and occurrences (seeds and candidates) with patterns.

    Candidates outside the base spans are identifier-like words, the same without a glued cue, and
    whole runs of digit groups ('(555) 123-4567'), each with the patterns around all of it. Runs are
    maximal, as the base cards and phones are. Of a text only this is kept. Time is in proportion
    to the text's length (but for a sort of its spans).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    first = first.withColumns({f"b{i}": c for i, c in enumerate(base_spans(F.col("text")))})
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    first = first.withColumns({"seeds": F.concat("b0", "b1", "b2", "b3"), "tokens": _spans(F.col("text"), _TOKEN, -1), "runs": _spans(F.col("text"), _RUN, -1, lambda v: digits(v) >= 7)})

    def part(x, v, at):
        """Of a match only ``v``, which stands ``at`` code points after its start."""
        s, n = x["s"] + at, F.length(v)
        before = F.right(F.concat(x["b"], F.left(x["v"], at)), F.lit(_BEFORE))
        after = F.left(F.concat(F.substring(x["v"], (at + n + 1).cast("int"), F.lit(_AFTER)), x["a"]), F.lit(_AFTER))
        return F.struct(s.cast("bigint").alias("s"), x["k"].alias("k"), (s + n).cast("bigint").alias("e"), v.alias("v"), before.alias("b"), after.alias("a"))

    def uncued(x):
        v = F.regexp_replace(x["v"], _CUE, "")
        return part(x, v, F.length(x["v"]) - F.length(v))

    bare = F.filter(F.transform(F.filter("tokens", lambda x: F.rlike(x["v"], F.lit(_CUE))), uncued), lambda x: F.rlike(x["v"], F.lit("^(?=.{6}).*[0-9@]")))
    free = _free(F.concat("tokens", bare, "runs"), F.col("seeds"))

    def trimmed(x):  # marks that end a sentence are no part of an identifier
        return part(x, F.regexp_replace(x["v"], r"[.,;:!?\"')\]}>]++$", ""), F.lit(0))

    def occurrence(x):
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), F.lower(x["v"]).alias("v"), _patterns(x["b"], x["a"]).alias("p"))

    # words and runs may be the same span: sorted, such are neighbours
    spans = F.sort_array(F.filter(F.transform(free, trimmed), lambda x: x["e"] > x["s"]))
    none = F.lit(-1).cast("bigint")
    apart = _running(spans, F.struct(none.alias("s"), none.alias("e")), lambda st, x: (F.struct(x["s"].alias("s"), x["e"].alias("e")), F.when((x["s"] != st["s"]) | (x["e"] != st["e"]), x)), _MATCH)["out"]
    found = F.transform(apart, occurrence)
    base = F.sort_array(F.transform("seeds", lambda x: F.struct(*[x[c].alias(c) for c in ("s", "k", "e", "v")])))
    return first.select("rid", "doc_id", base.alias("base"), F.concat(F.transform("seeds", occurrence), found).alias("spots"))


def _shape_fits(kind: Column, v: Column) -> Column:
    """Whether a string can be an identifier of a kind at all, whatever its context."""
    digits, other = F.length(F.regexp_replace(v, "[^0-9]", "")), F.length(F.regexp_replace(v, "[0-9 ().+-]", ""))
    return (
        F.when(kind == 0, F.rlike(v, F.lit(r"^[^@]+@[^@]+$")))
        .when(kind == 1, F.rlike(v, F.lit(r"^[0-9a-f]{1,4}([.:][0-9a-f]{0,4}){3,7}$")))
        .when(kind == 2, (other == 0) & digits.between(12, 19))
        .otherwise((other == 0) & digits.between(7, 15))
    )


def discover(scanned: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """Spans that high-confidence patterns find beside the base ones: rid, s, e, k, v.

    Edges join patterns with instances, each pair once. Seeds score 1 for their kind. In each
    round a pattern's confidence in a kind is the summed score of its instances over their
    number plus one, and an unseen instance scores 1 - prod(1 - confidence) over the patterns
    of at least half confidence that hold it. Patterns that end with ``confidence`` and
    ``support`` seeds or more name the kind of the unseen instances they hold, if their
    shape allows it.
    """
    spots = scanned.select("rid", F.explode("spots").alias("x")).select("rid", "x.*")
    edges = materialize(spots.select("k", "v", F.explode("p").alias("p")).groupBy("p", "v").agg(F.max("k").alias("k")), "pii_edges")
    sizes = edges.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("k") >= 0, 1).otherwise(0)).alias("seeds"))
    # patterns with too few seeds can never pass; what is left bounds the graph
    sizes = materialize(sizes.where(F.col("seeds") >= support), "pii_patterns")
    graph = materialize(edges.join(sizes.select("p", "n"), "p"), "pii_graph")
    known = graph.where("k >= 0").select("p", "n", "v", F.col("k").alias("kind"), F.lit(1.0).alias("score"))
    fresh = None
    for r in range(rounds):
        votes = known if fresh is None else known.unionByName(fresh)
        conf = votes.groupBy("p", "n", "kind").agg(F.sum("score").alias("total"), F.sum(F.when(F.col("score") == 1.0, 1).otherwise(0)).alias("sure"))
        conf = conf.select("p", "kind", "sure", (F.col("total") / (F.col("n") + 1)).alias("c"))
        if r + 1 == rounds:
            break
        good = conf.where("c >= 0.5")
        open_ = graph.where("k < 0")
        miss = F.sum(F.log(1 - F.least(F.col("c"), F.lit(0.999))))
        scores = open_.join(good, "p").groupBy("v", "kind").agg((1 - F.exp(miss)).alias("score")).where(F.col("score") < 1)
        fresh = materialize(open_.join(scores, "v").select("p", "n", "v", "kind", "score"), "pii_scores")
    strong = conf.where((F.col("c") >= confidence) & (F.col("sure") >= support)).select("p", "kind", "c")
    pairs = graph.where("k < 0").join(strong, "p").where(_shape_fits(F.col("kind"), F.col("v"))).select("p", "v", "kind", "c")
    pairs = materialize(pairs, "pii_pairs")
    kinds = pairs.groupBy("v").agg(F.max_by("kind", F.struct("c", -F.col("kind"))).alias("kind"))
    near = spots.where("k < 0").join(kinds, "v").select("rid", "s", "e", "kind", "v", F.explode("p").alias("p"))
    return near.join(pairs.select("p", "v").distinct(), ["p", "v"]).select("rid", "s", "e", F.col("kind").alias("k"), "v").distinct()


def find_personal_data(docs: DataFrame, rid: str | None = None, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """All spans of each document: rid, doc_id, base and spans (arrays of s, k, e, v; sorted by start, then kind).

    Positions are code points, ends exclusive; ``k`` indexes KINDS. ``spans`` has the base spans
    and those that contexts discovered; where kinds tie, the one listed first is taken. A null
    text is empty; a very long one is searched whole, in time linear in its length. Repeated
    rows each get their own result, also with a null doc_id. An empty table gives an empty
    result; other columns are ignored. ``rid`` names a column that tells rows apart.
    """
    if rid is None:
        rid, docs = "rid", docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    with scratch(docs.sparkSession):
        scanned = materialize(scan(docs, rid), "pii_scan")
        more = discover(scanned, rounds, confidence, support).groupBy(F.col("rid").alias("r")).agg(F.collect_set(F.struct("s", "k", "e", "v")).alias("more"))
        more = materialize(more, "pii_found")
        joined = scanned.join(more, F.col("rid") == F.col("r"), "left")
        every = F.sort_array(F.concat("base", F.coalesce(F.col("more").cast(_SPAN), F.array().cast(_SPAN))))
        return materialize(joined.select("rid", "doc_id", "base", every.alias("spans")), "pii_spans", keep=True)


def _names(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), k + 1)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(_names(x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans as text."""
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def _masked(text: Column, spans: Column, size: int = 1024) -> Column:
    """``text`` with its spans (sorted by start) replaced: pieces between them, cut from chunks of ``size`` code points."""
    step = lambda at, x: (F.greatest(at, x["e"]), F.when(x["s"] >= at, F.struct(at.alias("at"), x["s"].alias("s"), x["k"].alias("k"))))
    run = _running(spans, F.lit(0).cast("bigint"), step, "struct<at:bigint,s:bigint,k:int>")
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def piece(held, a, b):
        """Code points a to b."""
        i, j = F.floor(a / size).cast("int"), F.floor(b / size).cast("int")
        chunk = lambda k: F.coalesce(F.get(held, k), F.lit(""))
        one = F.substring(chunk(i), (a - i * size + 1).cast("int"), (b - a).cast("int"))
        more = F.concat(F.substring(chunk(i), (a - i * size + 1).cast("int"), F.lit(size)), F.array_join(F.slice(held, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(chunk(j), F.lit(1), (b - j * size).cast("int")))
        return F.when(i == j, one).otherwise(more)

    def whole(x):  # a struct of the chunks, the pass over the spans and the length, each made once
        parts = F.transform(x["run"]["out"], lambda y: F.concat(piece(x["held"], y["at"], y["s"]), F.lit("["), _names(y["k"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), piece(x["held"], x["run"]["st"], x["n"]))

    once = F.array(F.struct(chunks.alias("held"), run.alias("run"), F.length(text).cast("bigint").alias("n")))
    return F.element_at(F.transform(once, whole), 1)


def masked_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of spans that overlap the first stands for all.

    Columns are those of ``docs``, whatever their names; ``n_chars``, if there, is counted again. A
    null text stays null, an empty one empty. Repeated rows are masked one by one, also with
    a null doc_id. An empty table gives an empty result. Texts are read twice and shuffled
    once, in the join with their spans.
    """
    rows, file, row = with_row_key(docs, "pii_text")
    key, at, spans = unused(rows.columns, "pii_key", "pii_rid", "pii_spans")
    with scratch(docs.sparkSession):
        found = find_personal_data(rows.select("doc_id", "text", F.struct(file, row).alias(key)), key, **how).where(F.size("spans") > 0)
        found = materialize(found.select(F.col("rid").alias(at), F.col("spans").alias(spans)), "pii_masks", keep=True)
    joined = rows.withColumn(key, F.struct(file, row)).join(found.hint("merge"), F.col(key) == F.col(at), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(_masked(F.col("text"), F.col(spans)))
    done = joined.withColumn("text", text)
    chars = {"n_chars": F.length(F.col("text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.withColumns(chars).select(*docs.columns)
