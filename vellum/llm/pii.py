"""Personal data: base patterns, and more identifiers by bootstrapped contexts.  DataFrame operations only.

What the base patterns find are the seeds.  A lexical pattern is one or two words to the left of an identifier, one or two to
its right, or the nearest one of each side; words are lower-cased and without marks at their ends.  Patterns and the
identifiers (instances) that they stand beside form a graph: a pattern's confidence in a kind is the
mean score of its distinct instances, and an instance that is no seed scores by the patterns beside it, if it also has a
shape that seeds of the kind have.  After ROUNDS rounds what has a confident pattern and scores high is a new span.
A candidate is a token or the longest of several tokens of digits that has a seed's shape; a phone's may lack the country.
What scores high in a round counts as the seeds do for the words that can be patterns in the next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, id_text, thin

KINDS = ("email", "ip", "card", "phone")
#: Rounds; distinct seeds that a pattern needs; confidence of a pattern; score of a new instance.
ROUNDS, SUPPORT, CONFIDENT, SURE = 3, 8, 0.9, 0.9
#: Digits that a candidate of a kind has.
DIGITS = {"card": (12, 19), "phone": (7, 15)}
#: Elements of an array that are gone through in one piece.
CHUNK = 256

# The same matches as the plain patterns give: a run is tried from its first character, or from where the last match ended,
# and never given back where what follows can't be part of it.  So long runs take linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What could be an identifier: a run without white space that has a digit or an @.
TOKEN = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+"
#: Stands for the characters of base spans where more is looked for.
FILL = "\ue000"
_EDGE = rf"""\s,;:!?\[\]"'<>&%$#*|{FILL}"""
#: Tokens of digits with spaces between them, of which the first few can be one identifier of MANY digits.
RUN = rf"(?<![^{_EDGE}])[+(]{{0,2}}[0-9][0-9().-]{{0,23}}+(?:\x20{{1,2}}\(?[0-9][0-9().-]{{0,23}}+){{0,18}}(?![^{_EDGE}])"
MANY = (7, 19)
_MARKS = r"""[.,;:!?()\[\]"'<>&%$#*|]"""
_OUTER = rf"^{_MARKS}++|(?<!{_MARKS}){_MARKS}++$"


def _let(value: Column, body) -> Column:
    """``body(value)``, where ``value`` is computed once however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(values: Column) -> Column:
    """The arrays of CHUNK elements that make up an array."""
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(values), F.lit(CHUNK)), 1, F.ceil(F.size(values) / CHUNK).cast("int")), lambda at: F.slice(values, at + 1, F.lit(CHUNK)))


def _scan(some: Column, start: Column, op) -> Column:
    first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(some, first, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _before(chunks: Column, op) -> Column:
    """For each integer of an array in chunks what ``op`` (a sum or a maximum) makes of those before it, 0 for the first.

    An array that grows by one element is copied each time, so chunks are gone through by themselves after their totals: a million take seconds.
    """
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), op))
    return F.flatten(F.zip_with(chunks, _scan(totals, F.lit(0), op), lambda c, start: _scan(c, start, op)))


def _words(text: Column) -> Column:
    """Lower-cased words without marks at their ends, one space between them."""
    clean = F.regexp_replace(F.lower(text), rf"(?<![^\s])[^\p{{L}}\p{{N}}\s]++|(?<=[\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}\s]++(?!\S)", " ")
    return F.trim(F.regexp_replace(clean, r"\s++", " "))


def _matches(rows: DataFrame, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with a column array<struct<s, e, m, l, r>> for each name of ``wanted`` (a pattern, and which texts can have it): code points,
    the match, and up to two words before and after it, in lower case.  Each step is a column of its own, so that it is computed once."""

    def step(df: DataFrame, prefix: str, made) -> DataFrame:
        return df.select("*", *[made(name).alias(prefix + name) for name in wanted])

    def right(x: Column) -> Column:
        return _words(F.regexp_extract(x["a"], r"^[^\p{L}\p{N}]*+\S++(?:\s++\S++)?", 0))

    def placed(x: Column, at: Column) -> Column:
        start = at + F.length(x["b"])
        left = F.substring_index(_words(x["b"]), " ", -2)
        return F.struct(start.alias("s"), (start + F.length(x["m"])).alias("e"), x["m"].alias("m"), left.alias("l"), right(x).alias("r"))

    text = F.col("text")
    df = step(rows, "f_", lambda k: F.when(wanted[k][1], F.regexp_extract_all(text, F.lit(wanted[k][0]), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = step(df, "b_", lambda k: F.when(F.size(f"f_{k}") > 0, F.split(text, wanted[k][0], -1)).otherwise(F.array().cast("array<string>")))
    df = step(df, "p_", lambda k: F.arrays_zip(F.col(f"f_{k}").alias("m"), F.slice(f"b_{k}", 1, F.size(f"f_{k}")).alias("b"), F.slice(f"b_{k}", 2, F.size(f"f_{k}")).alias("a")))
    df = step(df, "c_", lambda k: _chunks(F.transform(f"p_{k}", lambda x: F.length(x["b"]) + F.length(x["m"]))))
    df = step(df, "s_", lambda k: _before(F.col(f"c_{k}"), lambda x, y: x + y))
    return step(df, "", lambda k: F.zip_with(f"p_{k}", f"s_{k}", placed)).select(*rows.columns, *wanted)


def _contexts(left: Column, right: Column) -> Column:
    """The patterns of an identifier between these words."""
    one, two = F.substring_index(left, " ", -1), F.substring_index(right, " ", 1)
    named = [(left != "", F.concat(F.lit("l "), one)), (left.contains(" "), F.concat(F.lit("ll "), left)), (right != "", F.concat(F.lit("r "), two)), (right.contains(" "), F.concat(F.lit("rr "), right)), ((left != "") & (right != ""), F.concat(F.lit("lr "), one, F.lit(" "), two))]
    return F.array_compact(F.array(*[F.when(given, name) for given, name in named]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


_RIGHT = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False))),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def _valid(kind: str) -> Column:
    return F.filter(kind, lambda x: _RIGHT[kind](x["m"]))


def _numbered(kind: str, k: int) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def _shape(m: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(m, "[A-Za-z]+", "a"), "[0-9]+", "9")
    return F.when(m.contains("@"), F.lit("@")).otherwise(plain)


def _replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with spans (s, e, k), sorted, replaced by ``by(span)``; of spans that overlap the first one stands for all.

    A chunk's part of the text is taken out once, as to find a place in a text takes as long as the text is.
    """

    def part(c: Column) -> Column:
        at, end = F.get(c, F.lit(0))["p"], F.element_at(c, -1)["s"]
        piece = lambda t, x: F.concat(F.substring(t, x["p"] - at + 1, x["s"] - x["p"]), by(x))
        return _let(F.substring(text, at + 1, end - at), lambda t: F.array_join(F.transform(c, lambda x: piece(t, x)), ""))

    ends = F.transform(spans, lambda x: x["e"])
    reach = _before(_chunks(ends), lambda x, y: F.greatest(x, y))
    fresh = F.filter(F.zip_with(spans, reach, lambda x, p: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), p.alias("p"))), lambda x: x["s"] >= x["p"])
    head = _let(fresh, lambda f: F.array_join(F.transform(_chunks(f), part), ""))
    return F.concat(head, F.substring(text, F.array_max(ends) + 1, F.length(text)))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, email, ip, card, phone, other, runs): the base spans of each row, and, in what base spans leave, tokens
    that could be identifiers and runs of several tokens."""
    rows = id_text(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    digit, at = F.col("text").rlike("[0-9]"), F.col("text").contains("@")
    gate = {"email": at, "ip": digit, "card": digit, "phone": F.col("text").contains("+") & digit}
    raw = _matches(rows, {k: (PATTERNS[k], gate[k]) for k in KINDS})
    kept = raw.select("id", "mark", "text", *[_valid(k).alias(k) for k in KINDS])
    base = F.concat(*[_numbered(k, i) for i, k in enumerate(KINDS)])
    kept = kept.withColumn("spans", F.array_sort(F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))))
    filled = F.when(F.size("spans") > 0, _replaced(F.col("text"), F.col("spans"), lambda x: F.repeat(F.lit(FILL), x["e"] - x["s"]))).otherwise(F.col("text"))
    left = kept.select("id", "mark", *KINDS, filled.alias("text"))
    some = _matches(left, {"token": (TOKEN, digit | at), "run": (RUN, digit)}).drop("text")

    def trimmed(x: Column) -> Column:
        lead, tail = F.length(F.regexp_extract(x["m"], f"^{_MARKS}++", 0)), F.length(F.regexp_extract(x["m"], f"(?<!{_MARKS}){_MARKS}++$", 0))
        return F.struct((x["s"] + lead).alias("s"), F.greatest(x["e"] - tail, x["s"] + lead).alias("e"), F.regexp_replace(x["m"], _OUTER, "").alias("m"), x["l"].alias("l"), x["r"].alias("r"))

    other = F.filter(F.transform("token", trimmed), lambda x: (x["e"] > x["s"]) & ~x["m"].contains(FILL))
    runs = F.filter("run", lambda x: x["m"].contains(" ") | x["m"].startswith("("))
    return some.select("id", "mark", *KINDS, other.alias("other"), runs.alias("runs"))


def _shapes(seeds: DataFrame) -> DataFrame:
    """(kind, shape, bare): shapes of enough seeds, and bare ones, which are a phone's without the country."""
    full = seeds.groupBy("kind", "shape").agg(F.count_distinct("instance").alias("c")).where(F.col("c") >= SUPPORT).select("kind", "shape", F.lit(False).alias("bare"))
    bare = full.where("kind = 'phone'").select("kind", F.regexp_replace("shape", r"^\+9[\x20.-]*", "").alias("shape"), F.lit(True).alias("bare"))
    return full.unionByName(bare.where(F.col("shape").rlike("[^9]"))).groupBy("kind", "shape").agg(F.min("bare").alias("bare"))


def _shaped(rows: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose instance has a shape of ``shapes`` and as many digits as its kind can have."""
    n, fits = F.length(_digits(F.col("instance"))), F.lit(True)
    for kind, (least, most) in DIGITS.items():
        fits = fits & ((F.col("kind") != kind) | n.between(least, most))
    return rows.join(shapes, keys).where(fits).drop("bare")


def _candidates(table: DataFrame, shapes: DataFrame) -> DataFrame:
    """(id, mark, s, e, l, r, instance, shape): at each place the longest run of tokens that has a seed's shape, or else the token."""
    runs = table.select("id", "mark", F.explode("runs").alias("x"))
    pieces = F.split("x.m", "(?<=[^ ])(?= )")
    begun = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda j: F.regexp_replace(F.array_join(F.slice(pieces, 1, j), ""), "[().-]+$", ""))
    runs = runs.select("id", "mark", "x", F.explode(begun).alias("m")).where(F.length(_digits(F.col("m"))).between(*MANY) & (F.col("m").contains(" ") | F.col("m").startswith("(")))
    runs = runs.select("id", "mark", (F.col("x.s") + F.length(F.regexp_extract("m", r"^\(+", 0))).alias("at"), "x.s", (F.col("x.s") + F.length("m")).alias("e"), F.col("x.e").alias("stop"), F.col("x.l").alias("l"), F.when(F.length("m") == F.length("x.m"), F.col("x.r")).otherwise("").alias("r"), F.lower("m").alias("instance"), _shape(F.col("m")).alias("shape"))
    whole = _shaped(runs.where("e <= stop"), shapes, ["shape"]).groupBy("id", "mark", "at", "s", "l").agg(F.max_by(F.struct("e", "r", "instance", "shape"), "e").alias("x"))
    whole = cut(whole.select("id", "mark", "at", "s", "x.e", "l", "x.r", "x.instance", "x.shape"), "pii-runs")
    tokens = table.select("id", "mark", F.explode("other").alias("x")).select("id", "mark", "x.s", "x.e", "x.l", "x.r", F.lower("x.m").alias("instance"), _shape(F.col("x.m")).alias("shape"))
    places = whole.select("mark", F.col("at").alias("s")).distinct()
    return tokens.join(thin(places), ["mark", "s"], "left_anti").select("id", "mark", "s", "e", "l", "r", "instance", "shape").unionByName(whole.drop("at"))


def bootstrap(table: DataFrame) -> DataFrame:
    """(id, mark, kind, s, e): new spans of a table as ``found`` gives it."""
    kinds = reduce(DataFrame.unionByName, [table.select("id", "mark", F.lit(k).alias("kind"), F.explode(k).alias("x")) for k in KINDS])
    seeds = kinds.select("kind", F.explode_outer(_contexts(F.col("x.l"), F.col("x.r"))).alias("pattern"), F.lower("x.m").alias("instance"), _shape(F.col("x.m")).alias("shape")).distinct()
    seeds = cut(seeds, "pii-seeds")
    shapes = cut(_shapes(seeds), "pii-shapes")
    every = _candidates(table, shapes).withColumn("pattern", F.explode(_contexts(F.col("l"), F.col("r")))).drop("l", "r")
    sure = seeds.select("kind", "instance").distinct().withColumn("score", F.lit(1.0))
    scores, links, words = sure, seeds.select("kind", "pattern", "instance"), None
    for k in range(ROUNDS):
        if k:
            fresh = cut(scores.where(F.col("score") >= SURE).join(sure, ["kind", "instance"], "left_anti").select("kind", "instance"), "pii-fresh")
            if fresh.isEmpty():  # the round would be the last one again
                break
            links = seeds.select("kind", "pattern", "instance").unionByName(every.join(thin(fresh), "instance").select("kind", "pattern", "instance"))
        # only words that stand before enough seeds or accepted instances can be patterns; their count is bounded by those, not by the texts
        able = links.where("pattern is not null").groupBy("kind", "pattern").agg(F.count_distinct("instance").alias("seeds")).where(F.col("seeds") >= SUPPORT)
        able = cut(able.select("kind", "pattern"), "pii-patterns")
        if words is None and able.isEmpty():  # no pattern has the support it needs, so nothing new can be found
            return table.sparkSession.createDataFrame([], "id long, mark long, kind string, s int, e int")
        if words is None or not able.join(words, "pattern", "left_anti").isEmpty():
            words = able.select("pattern").distinct()
            others = cut(every.join(thin(words), "pattern", "left_semi"), "pii-candidates")
            edges = cut(seeds.select("pattern", "instance", "shape").unionByName(others.select("pattern", "instance", "shape")).distinct().join(thin(words), "pattern", "left_semi"), "pii-graph")
            totals = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("all"))
        patterns = edges.select("pattern", "instance").distinct().join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"))
        patterns = patterns.join(totals, "pattern").join(able, ["kind", "pattern"], "left_semi").select("pattern", "kind", (F.col("sum") / F.col("all")).alias("conf"))
        patterns = cut(patterns.where(F.col("conf") >= CONFIDENT), "pii-scored")
        doubt = F.sum(F.log(F.greatest(F.lit(0.01), 1 - F.col("conf"))))
        new = _shaped(edges.join(patterns, "pattern"), shapes, ["kind", "shape"]).groupBy("kind", "instance").agg((1 - F.exp(doubt)).alias("score"))
        scores = cut(sure.unionByName(new.join(sure, ["kind", "instance"], "left_anti")), "pii-scores")
    good = scores.where(F.col("score") >= SURE).join(sure.select("kind", "instance"), ["kind", "instance"], "left_anti")
    hits = _shaped(others.join(patterns, "pattern"), shapes, ["kind", "shape"]).join(good, ["kind", "instance"])
    best = hits.groupBy("id", "mark", "s", "e").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))
    return best.select("id", "mark", "kind", "s", "e")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_new of every row.

    Counts and base_sha256 are of the base patterns' spans, in code points; spans has those and the new ones, by kind and then
    start, as kind:start:end.  A null or empty text has none.  Rows that repeat get the same; rows that share an id are told apart by their
    texts; a null id stays null; an empty table gives no rows; other columns are ignored.
    """
    table = cut(found(docs, id_col, text_col), "pii-found")
    return _reported(table, bootstrap(table)).drop("mark", "all")


def _reported(table: DataFrame, new: DataFrame) -> DataFrame:
    new = cut(new, "pii-new")
    more = new.groupBy(F.col("id").alias("nid"), F.col("mark").alias("nmark")).agg(F.collect_set(F.struct("kind", "s", "e")).alias("new"))
    no = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    rows = table.join(thin(more, new.count()), F.col("id").eqNullSafe(F.col("nid")) & (F.col("mark") == F.col("nmark")), "left")
    base = F.concat(*[_numbered(k, i) for i, k in enumerate(KINDS)])
    number = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.array_sort(F.concat(base, F.transform(F.coalesce("new", no), lambda x: F.struct(number[x["kind"]].alias("k"), x["s"].alias("s"), x["e"].alias("e")))))
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

    return rows.select(
        F.col("id").alias("doc_id"), "mark", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(every).alias("spans"), F.size(F.coalesce("new", no)).cast("long").alias("n_new"), every.alias("all"),
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span in its text replaced by its kind in angle brackets; every other column and row as it was.

    Overlapping spans become one mask, of the kind of the first.  A null text stays null.
    """
    table = cut(found(docs, id_col, text_col), "pii-found")
    spans = _reported(table, bootstrap(table)).where(F.size("all") > 0).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.array_sort(F.transform("all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))).alias("__all")).dropDuplicates(["__id", "__mark"])
    spans = cut(spans, "pii-spans")
    size = spans.agg(F.sum(F.size("__all"))).first()[0] or 0  # of all spans, as rows have as many as their texts
    text = F.col(f"`{text_col}`")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    done = _replaced(text, F.col("__all"), lambda x: F.get(names, x["k"]))
    keyed = docs.withColumn("__m", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    rows = keyed.join(thin(spans, size), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")), "left")
    return rows.withColumn(text_col, F.when(F.col("__all").isNotNull(), done).otherwise(text)).select(*[f"`{c}`" for c in docs.columns])
