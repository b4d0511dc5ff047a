"""Personal data in texts: weak supervision over regex, gazetteer and context labelers, in SQL functions alone.

Base spans follow fixed patterns and checks and always stay. Candidates are all matches of those patterns, also
those that fail their check, and matches of looser patterns of every kind: spelt-out and bracketed addresses, defanged and
version 6 network addresses, card numbers with unusual marks between their digits, phone numbers without a plus, or with one
and so many digits behind them that the base match fails. Three
labelers vote +1, 0 or -1 on each candidate: its kind's check (well-formed address, parts of a network address, Luhn,
number of digits), a gazetteer (top-level domains, special address blocks, issuer ranges, country and area codes), and
words in the 60 characters before it. The number of candidates of each vote pattern (at most 27 a kind) is all that
expectation-maximisation needs: a two-class model with its own reliability for each labeler, vote and class gives
each pattern its probability. These are the soft labels of the span classifier, a naive Bayes model over shape
features and what gazetteer and context say, which decides on the candidates that are not base spans; a match whose own check fails is never added.

Positions are code points: a text is split at the matches, and lengths of pieces and matches add up, run by run of RUN
matches, so a text with a million of them takes time in proportion. The patterns are possessive where the language allows
it, so no input makes them backtrack or recurse deeply.

Defined results: a null or empty text counts as empty (no spans); repeated rows give repeated results; a null doc_id
stays null; spans that start together are ordered by kind, then end; without any candidate nothing is trained or added; an
empty table gives an empty result; a very long text is one task's work; other columns, clashing names too, are ignored by
:func:`find` and passed on by :func:`redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import Stage, fresh, read

KINDS = ("email", "ip", "card", "phone")

# The base patterns are fixed values; lookbehinds and possessive quantifiers leave what they match unchanged.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?:"
    r"\x20?[\[({]at[\])}]\x20?[a-z0-9-]{1,63}(?:(?:\x20?[\[({]dot[\])}]\x20?|\.)[a-z0-9-]{1,63}){0,3}(?:\x20?[\[({]dot[\])}]\x20?|\.)"
    r"|\x20at\x20[a-z0-9-]{1,63}(?:\x20dot\x20[a-z0-9-]{1,63}){0,3}\x20dot\x20)[a-z]{2,24}(?![a-z0-9])",
    "ip": r"(?i)(?<![0-9a-f.:])(?:[0-9]{1,3}(?:\x20?[\[({](?:\.|dot)[\])}]\x20?[0-9]{1,3}){3}(?![0-9])"
    r"|(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:.])|[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5}::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?(?![0-9a-f:.]))",
    "card": r"(?<![0-9._/+-])(?:[0-9]{4}([._/]|\x20{2}|\x20?[\u2013-]\x20?)[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}(?:\1[0-9]{3})?|[0-9]{4}([._/])[0-9]{6}\2[0-9]{5})(?![0-9._/-])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])(?![./-][0-9])(?=[\x20().-]+[0-9])"
    r"|(?<![0-9+./-])(?<!\+[0-9]{1,3}[\x20.-]{0,2})(?:(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9]{0,2}[\x20.-](?:[0-9][\x20.-]?){6,12}[0-9])(?![0-9./-])",
}
#: A text without this can hold no match.
NEEDS = {"email": "@", "phone": "\\+"}
LOOSE_NEEDS = {
    "email": r"(?i)[\[({\x20]at[\])}\x20]",
    "ip": r"[0-9](?:\x20?[\[({](?:\.|[Dd][Oo][Tt])|:)|::",
    "card": r"[0-9]{4}(?:[._/\u2013-]|\x20[\x20\u2013-])",
    "phone": r"[0-9]{3}[\x20.-][0-9]{4}|00[1-9]",
}

# Top-level domains in common use, endings of file names, blocks of addresses that name no host,
# issuer ranges with the lengths of their numbers, and the country codes of the numbering plan.
DOMAINS = (
    "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia app dev io ai co me tv cc xyz online site store shop club cloud blog "
    "ac ad ae af ag al am ao ar at au az ba bb bd be bf bg bh bi bj bn bo br bs bt bw by bz ca cd cf cg ch ci cl cm cn cr cu cv cy cz de dj dk dm do dz ec ee eg es et eu "
    "fi fj fo fr ga gd ge gh gi gl gm gn gr gt gy hk hn hr ht hu id ie il in iq ir is it jm jo jp ke kg kh kr kw ky kz la lb li lk lt lu lv ly ma mc md mg mk ml mn mo mt mu "
    "mw mx my mz na ne ng ni nl no np nz om pa pe pg ph pk pl pr ps pt py qa ro rs ru rw sa sc sd se sg si sk sn so su sv sy sz th tj tm tn to tr tt tw tz ua ug uk us uy uz"
).split()
FILES = "png jpg jpeg gif svg css js json html htm txt xml pdf zip csv py java cpp".split()
NO_HOST = r"^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])[^0-9]"
ISSUERS = (
    r"^(4([0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|(222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}"
    r"|(6011|64[4-9][0-9]|65[0-9]{2})[0-9]{12,15}|35(2[89]|[3-8][0-9])[0-9]{12,15}|(30[0-5]|3095|36|3[89])[0-9]{10,16}|62[0-9]{14,17}|(50|5[6-8])[0-9]{10,17})$"
)
COUNTRIES = r"(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|6[789][0-9]|80[08]|85[0-9]|8[78][0-9]|96[0-9]|97[0-9]|99[0-9])"

CONTEXT = {
    "email": (r"(?i)(mail|contact|write|reach|send)", r"(?i)(version|regex|example of)"),
    "ip": (r"(?i)(\bip\b|host|server|address|login|client)", r"(?i)(version|section|chapter|\bv)\W*$"),
    "card": (r"(?i)(card|visa|master|credit|debit|payment|paid)", r"(?i)(isbn|order|invoice|serial|number of|id)\W*$"),
    "phone": (r"(?i)(phone|call|tel|fax|mobile|cell|dial)", r"(?i)(isbn|order|invoice|serial|version)\W*$"),
}
#: Characters before a match that its context labeler sees, and matches whose lengths are added up in one run.
SEEN, RUN = 60, 64
#: Rounds of expectation-maximisation; spans that each class of the classifier is smoothed with.
ROUNDS, SMOOTH = 25, 2.0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of a card's digits, every second from the right doubled, divisible by ten."""

    def add(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    d = _digits(s)
    if kind == "card":
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    return F.length(d).between(9, 15)


def _checked(kind: str, base: bool, s: Column) -> Column:
    """What the first labeler looks at: the kind's check, on what stands for a dot or an at sign as on these."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(s, r"(?i)\x20?[\[({]at[\])}]\x20?|\x20at\x20", "@"), r"(?i)\x20?[\[({]dot[\])}]\x20?|\x20dot\x20", ".")
        return plain.rlike(r"^(?!\.)(?!.*\.\.)(?!.*\.@)[^@]{1,64}@(?!-)(?!.*-(\.|$))(?!.*\.-).{1,253}$")
    if kind == "ip" and not base:
        return F.contains(s, F.lit(":")) & (F.length(F.regexp_replace(s, "[^0-9a-fA-F]", "")) > 2) | _passes(kind, F.regexp_replace(s, r"(?i)\x20?[\[({](\.|dot)[\])}]\x20?", "."))
    return _passes(kind, s)


def _listed(kind: str, s: Column) -> tuple[Column, Column]:
    """What the gazetteer says for and against."""
    d = _digits(s)
    if kind == "email":
        last = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1))
        return last.isin(DOMAINS), last.isin(FILES)
    if kind == "ip":
        return ~s.rlike(NO_HOST) & ~s.rlike(r"^[0-9](\.[0-9]){3}$"), s.rlike(NO_HOST) | s.rlike(r"^[0-9](\.[0-9]){3}$")
    if kind == "card":
        return d.rlike(ISSUERS), d.rlike("^[01789]")
    area = r"^\(?[2-9][0-8][0-9]\)?[\x20.-]?[2-9]"
    return s.rlike(rf"^(\+|00){COUNTRIES}[^0-9]|^\+{COUNTRIES}[0-9]") | s.rlike(area), s.rlike(r"^\+0|^\(?[01][0-9]{2}\)?[\x20.-]|^\(?[2-9]11\)?[\x20.-]")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _length_class(x: Column) -> Column:
    return F.concat(F.lit("n"), F.least(F.floor(F.length(x) / 4), F.lit(8)).cast("string"))


def _span(kind: str, base: bool, start: Column, s: Column, before: Column) -> Column:
    """Start, kind, end, whether a base span, votes and features of one match."""
    ok = _passes(kind, s) if base else F.lit(False)
    sound = _checked(kind, base, s)
    last = F.right(before, F.lit(1))
    votes = [_vote(sound, ~sound), _vote(*_listed(kind, s)), _vote(before.rlike(CONTEXT[kind][0]), before.rlike(CONTEXT[kind][1]))]
    shape = [
        F.concat(F.lit(f"{kind}|first|"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.left(s, F.lit(1)), "[0-9]", "9"), "[A-Za-z]", "a"), "[^9a+(]", "-")),
        F.concat(F.lit(f"{kind}|digits|"), F.least(F.length(_digits(s)), F.lit(20)).cast("string")),
        F.concat(F.lit(f"{kind}|marks|"), F.least(F.length(F.regexp_replace(s, "[0-9A-Za-z]", "")), F.lit(8)).cast("string")),
        F.concat(F.lit(f"{kind}|size|"), _length_class(s)),
        F.concat(F.lit(f"{kind}|after|"), F.when(last == "", "^").when(last.rlike(r"\s"), "_").when(last.rlike("[0-9]"), "9").when(last.rlike(r"\w"), "a").otherwise("-")),
        F.concat(F.lit(f"{kind}|listed|"), votes[1].cast("string")),
        F.concat(F.lit(f"{kind}|context|"), votes[2].cast("string")),
    ]
    names = [x.alias(f"v{i}") for i, x in enumerate(votes, 1)]
    return F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(s)).cast("long").alias("end"), ok.alias("base"), *names, F.array(*shape).alias("shape"))


def _let(value: Column, body) -> Column:
    """body of a value that is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ends(lens: Column) -> Column:
    """Running sums of an array of integers: of whole runs first, then within each run."""
    zero = F.lit(0).cast("long")

    def total(first, n):
        return F.aggregate(F.slice(lens, first + 1, n), zero, lambda t, x: t + x)

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / RUN).cast("int")), lambda r: total(r * RUN, F.lit(RUN)))
    start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("before"))
    before = F.aggregate(runs, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before")), lambda a: a["before"])
    return _let(before, lambda b: F.transform(lens, lambda x, i: F.get(b, F.floor(i / RUN).cast("int")) + total(F.floor(i / RUN).cast("int") * RUN, i % RUN + 1)))


def _matches(df: DataFrame, text: str, name: str, kind: str, pattern: str, base: bool, needs: str) -> DataFrame:
    """df with the array column `name` of the spans of one pattern."""
    t = F.col(text)
    df = df.withColumn(name + "_m", F.when(t.rlike(needs), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    df = df.withColumn(name + "_p", F.when(F.size(name + "_m") > 0, F.split(t, pattern, -1)))

    def one(m, p, ends, i):
        own = F.struct((F.get(ends, i) - F.length(F.get(m, i))).alias("at"), F.get(m, i).alias("s"), F.right(F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(p, i)), F.lit(SEEN)).alias("before"))
        return _let(own, lambda x: _span(kind, base, x["at"], x["s"], x["before"]))

    def every(x):
        m, p = x["m"], x["p"]
        lens = F.transform(m, lambda s, i: (F.length(s) + F.length(F.get(p, i))).cast("long"))
        return _let(_let(lens, _ends), lambda ends: F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: one(m, p, ends, i)))

    m, p = F.col(name + "_m"), F.col(name + "_p")
    none = F.filter(F.array(_span(kind, base, F.lit(0), F.lit(""), F.lit(""))), lambda x: F.lit(False))
    return df.withColumn(name, F.when(F.size(m) > 0, _let(F.struct(m.alias("m"), p.alias("p")), every)).otherwise(none)).drop(name + "_m", name + "_p")


def candidates(docs: DataFrame, text: str, into: str) -> DataFrame:
    """docs with the array column `into` of all candidate spans of the text column, which holds no nulls."""
    names = []
    for kind in KINDS:
        for base, patterns, needs in ((True, PATTERNS, NEEDS), (False, LOOSE, LOOSE_NEEDS)):
            names.append(f"{into}_{kind}_{'b' if base else 'l'}")
            docs = _matches(docs, text, names[-1], kind, patterns[kind], base, needs.get(kind, "[0-9]"))
    return docs.withColumn(into, F.concat(*names)).drop(*names)


def posteriors(spans: DataFrame) -> DataFrame:
    """(kind, v1, v2, v3, p): expectation-maximisation over the counts of vote patterns of each kind."""
    counts = spans.groupBy("kind", "v1", "v2", "v3").agg(F.count("*").cast("double").alias("n"))
    one = counts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("v1", "v2", "v3", "n"))).alias("x"))
    # the state: share of true spans, then P(vote | class) for 3 labelers x 3 votes x (false, true)
    chance = "state.a[(cast({v} as int) + 1) * 2 + {j} * 6 + {y}]"
    joint = {y: ("state.pi" if y else "(1 - state.pi)") + "".join(" * " + chance.format(v=f"p.v{j + 1}", j=j, y=y) for j in range(3)) for y in (0, 1)}
    weight = f"({joint[1]}) / ({joint[0]} + {joint[1]})"
    mass = "(case when k % 2 = 1 then w[i] else 1 - w[i] end) * x[i].n"
    vote = "(case when k div 6 = 0 then x[i].v1 when k div 6 = 1 then x[i].v2 else x[i].v3 end) + 1 = (k % 6) div 2"
    every = "aggregate(sequence(0, size(x) - 1), 0.5D, (s, i) -> s + {})"
    step = f"""
      transform(array(transform(x, p -> {weight})), w -> named_struct(
        'pi', {every.format("w[i] * x[i].n")} / ({every.format("x[i].n")} + 0.5D),
        'a', transform(sequence(0, 17), k -> ({every.format(f"if({vote}, {mass}, 0D)")}) / ({every.format(mass)} + 1D))))[0]"""
    start = "named_struct('pi', 0.5D, 'a', array(0.7D,0.1D,0.2D,0.2D,0.1D,0.7D,0.6D,0.2D,0.3D,0.3D,0.1D,0.5D,0.6D,0.1D,0.35D,0.5D,0.05D,0.4D))"
    fitted = one.withColumn("state", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (state, turn) -> {step})"))
    return fitted.select("kind", F.expr(f"explode(transform(x, p -> named_struct('v1', p.v1, 'v2', p.v2, 'v3', p.v3, 'p', {weight})))").alias("r")).select("kind", "r.*")


def train(spans: DataFrame) -> dict[str, float]:
    """Log odds of the span classifier: of each kind ('email|prior') and each shape feature.

    One value a kind and feature, fewer than 300 in all whatever the corpus.
    """
    labelled = spans.join(F.broadcast(posteriors(spans)), ["kind", "v1", "v2", "v3"])  # at most 27 rows a kind
    soft = [F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")]
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    kinds = labelled.groupBy(F.concat(names, F.lit("|prior")).alias("f")).agg(*soft)
    shapes = labelled.select(F.explode("shape").alias("f"), "p").groupBy("f").agg(*soft)
    rows = kinds.union(shapes).collect()
    prior = {r.f.split("|")[0]: r for r in rows if r.f.endswith("|prior")}
    out = {}
    for r in rows:
        k = prior[r.f.split("|")[0]]
        if r.f.endswith("|prior"):
            out[r.f] = math.log((r.yes + 0.5) / (r.no + 0.5))
        else:  # each class starts from the share of the feature in all spans, so a class that is hardly seen decides nothing
            share = SMOOTH * (r.yes + r.no) / (k.yes + k.no)
            out[r.f] = math.log((r.yes + share) / (k.yes + SMOOTH) / ((r.no + share) / (k.no + SMOOTH)))
    return out


def _accepted(spans: Column, weights: dict[str, float]) -> Column:
    """Base spans, and others by the classifier if they touch no base span; by start, then kind."""
    base = F.filter(spans, lambda s: s["base"])
    if not weights:
        return F.array_sort(base)
    table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w)])
    prior = F.array(*[F.lit(weights.get(f"{k}|prior", -99.0)) for k in KINDS])

    def score(s):
        return F.aggregate(s["shape"], F.get(prior, s["kind"]), lambda t, f: t + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))

    def fits(s):
        touching = F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return ~s["base"] & (s["v1"] >= 0) & (score(s) > 0) & ~touching

    return F.array_sort(F.concat(base, F.filter(spans, fits)))


def _shown(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _flat(table: DataFrame, column: str) -> DataFrame:
    return table.select(F.explode(column).alias("s")).select("s.*")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs (doc_id, text)."""
    stage = Stage(docs.sparkSession, "pii")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stage.write(candidates(rows, "text", "spans").select("doc_id", "spans"), "candidates")
    weights = train(_flat(found, "spans"))
    base = F.array_sort(F.filter("spans", lambda s: s["base"]))

    def count(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(_shown(base), 256).alias("base_sha256"), _shown(_accepted(F.col("spans"), weights)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with every span of `text` replaced by its kind in square brackets; overlapping ones by the first's."""
    stage = Stage(docs.sparkSession, "pii-redact")
    spans, safe = fresh(docs, "pii_spans"), fresh(docs, "pii_text")
    told = stage.write(candidates(docs.withColumn(safe, F.coalesce("text", F.lit(""))), safe, spans).drop(safe), "candidates")
    weights = train(_flat(told, spans))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    told = told.withColumn(safe, F.coalesce("text", F.lit(""))).withColumn(spans, _accepted(F.col(spans), weights))
    t, s = F.col(safe), F.col(spans)

    def step(state, x):
        skip = x["start"] < state["at"]
        piece = F.concat(state["out"], F.substring(t, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int")), F.get(marks, x["kind"]))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(skip, state["out"]).otherwise(piece).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(s, start, step, lambda r: F.concat(r["out"], F.substring(t, (r["at"] + 1).cast("int"), F.length(t))))
    return told.withColumn("text", F.when(F.size(s) > 0, clean).otherwise(F.col("text"))).select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
