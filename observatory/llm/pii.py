"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Exact rules find the base spans. Looser patterns find further candidates in what the
base spans leave of a text. Five labelers (the exact rule alone on the span, its shape,
a gazetteer, the words before it, what it touches) vote on each span, base or not;
expectation-maximisation estimates from the votes of all spans how far each labeler is
right, and a logistic regression on votes and further features, trained on the estimated
labels of all spans, decides which candidates are added.

All of it is DataFrame functions: spans are arrays in their document's row, so that
nothing is joined and nothing but counts of vote patterns is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.shared import cut

KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["rule", "shape", "gazetteer", "context", "touch"]

# The exact rules. Possessive, so that no text overflows the stack or is read twice: no class that ends a part
# can begin the next one. A match begins where a run does, or where the last match ends.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

# Candidates beside them, looked for in this order in what all spans so far leave.
LOOSE = {
    "card": r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?)(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9.])",
    "email": r"(?i)[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|<at>) ?[a-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}|<dot>) ?[a-z0-9-]{1,63}){1,8}",
}
#: Without one of these a text has no span of the kind.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_NEEDS_LOOSE = {"card": "[0-9]{4}", "phone": "[0-9]{3}", "ip": r"[0-9]\.[0-9]", "email": r"(?i)[(\[{<]at[)\]}>]"}

# Common top-level domains, international calling codes, issuers' first digits.
DOMAINS = "com org net edu gov int info biz io co us uk de fr es it nl be ch at pl pt se no fi dk ie eu ru cn jp kr in br mx ar ca au nz za".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 234 254 255 256 351 352 353 354 355 358 359 370 371 372 380 385 386 420 421 852 880 886 961 962 963 964 965 966 971 972 974 977 994 995 998".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
RESERVED = r"^0*(?:0|127|2[4-9][0-9])\."
WORDS = {
    "email": r"e-?mail|write to|contact|correo|courriel|adresse",
    "ip": r"\bip\b|addr|host|server|client|login",
    "card": r"card|visa|master|credit|debit|karte|carte|tarjeta|payment",
    "phone": r"phone|\btel|call|mobile|fax|telefon|téléphone|teléfono|handy",
}
AGAINST = r"(?:token|passw|secret|key|sha|md5|hash|uuid|isbn|version|\bv|order|invoice|ticket|serial|build)[^\r\n]{0,6}$"

#: Code points before and behind a span that labelers see.
BEFORE, BEHIND = 48, 8
#: How far a labeler is taken to be right before any votes are seen, and for how many votes that stands.
PRIOR = {"rule": 0.95, "shape": 0.75, "gazetteer": 0.75, "context": 0.85, "touch": 0.65}
PRIOR_VOTES = 20.0
ROUNDS = 15
THRESHOLD = 0.5

_BLANK = "\u0000"
_CHUNK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """The sums of all that stands before each element of a non-empty array, in blocks so that long arrays take n * _CHUNK steps."""

    def sums(part: Column) -> Column:
        zero = F.struct(F.array().cast("array<bigint>").alias("a"), F.lit(0).cast("bigint").alias("s"))
        return F.aggregate(part, zero, lambda t, x: F.struct(F.concat(t["a"], F.array(t["s"])).alias("a"), (t["s"] + x).alias("s")))

    def blocks(a: Column) -> Column:
        last = F.floor((F.size(a) - 1) / _CHUNK).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), last), lambda c: sums(F.slice(a, c * _CHUNK + 1, _CHUNK))), joined)

    def joined(parts: Column) -> Column:
        ahead = sums(F.transform(parts, lambda p: p["s"]))["a"]
        return F.flatten(F.zip_with(parts, ahead, lambda p, t: F.transform(p["a"], lambda v: v + t)))

    return _let(lengths, blocks)


_EMPTY = "array<struct<start:bigint,end:bigint,text:string,before:string,behind:string>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """(start, end, text, before, behind) of each match, in code points."""

    def placed(s: Column) -> Column:
        n = F.size(s["hits"])
        gaps = F.slice(s["gaps"], 1, n)
        one = F.zip_with(s["hits"], gaps, lambda h, g: F.struct(h.alias("h"), g.alias("g")))
        starts = running(F.transform(one, lambda x: (F.length(x["h"]) + F.length(x["g"])).cast("bigint")))
        two = F.zip_with(one, starts, lambda x, p: F.struct(x["h"].alias("h"), x["g"].alias("g"), (p + F.length(x["g"])).alias("p")))
        row = lambda x, after: F.struct(x["p"].alias("start"), (x["p"] + F.length(x["h"])).alias("end"), x["h"].alias("text"), F.substring(x["g"], -BEFORE, BEFORE).alias("before"), F.substring(after, 1, BEHIND).alias("behind"))
        return F.when(n == 0, F.array().cast(_EMPTY)).otherwise(F.zip_with(two, F.slice(s["gaps"], 2, n), row))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(needs), _let(parts, placed)).otherwise(F.array().cast(_EMPTY))


def valid(kind: str, hit: Column) -> Column:
    """What the exact rule asks of its match: octets, digits, check digit."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def blanked(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """The text with as many blanks in place of each match that ``keep`` is true for."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    blank = lambda g, h: F.when(h.isNull(), g).otherwise(F.concat(g, F.when(keep(h), F.repeat(F.lit(_BLANK), F.length(h))).otherwise(h)))
    return _let(parts, lambda s: F.array_join(F.zip_with(s["gaps"], s["hits"], blank), ""))


def _votes(kind: str, x: Column) -> dict[str, Column]:
    """Each labeler's vote on a span of this kind: 1, -1, or 0 where it has no opinion."""
    hit, digits = x["text"], F.regexp_replace(x["text"], "[^0-9]", "")
    either = lambda yes: F.when(yes, 1).otherwise(-1)
    if kind == "email":
        plain = hit.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*\.[A-Za-z]{2,24}$")
        shape = either(plain | hit.rlike(r"(?i)^[a-z0-9][a-z0-9._%+-]*+ ?[(\[{<]at"))
        known = F.when(F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1)).isin(DOMAINS), 1).otherwise(0)
    elif kind == "ip":
        shape = either(hit.rlike(r"^(?:[1-9]?[0-9]|1[0-9]{2}|2[0-9]{2})(?:\.(?:[1-9]?[0-9]|1[0-9]{2}|2[0-9]{2})){3}$"))
        known = F.when(hit.rlike(RESERVED), -1).otherwise(0)
    elif kind == "card":
        shape = F.when(hit.rlike(r"^(?:[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"), 1).otherwise(F.when(hit.rlike("^[0-9]+$"), 0).otherwise(-1))
        known = either(digits.rlike(ISSUERS))
    else:
        shape = either(hit.rlike(r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}$"))
        code = F.regexp_extract(hit, r"^\+([0-9]{1,3})", 1)
        known = F.when(code == "", 0).otherwise(either(code.isin(CALLING) | F.substring(code, 1, 2).isin(CALLING) | F.substring(code, 1, 1).isin("1", "7")))
    # one expression may read nothing but the span, so the rule's own words are repeated by a full match
    rule = either(hit.rlike(f"^(?:{BASE[kind].replace(chr(92) + 'G|', '')})$") & valid(kind, hit))
    before = F.lower(x["before"])
    context = F.when(before.rlike(AGAINST), -1).otherwise(F.when(before.rlike(WORDS[kind]), 1).otherwise(0))
    touch = either(~(x["before"].rlike(r"[\p{L}\p{N}_=/\"#]$") | x["behind"].rlike(r"^[\p{L}\p{N}_@]")))
    return {"rule": rule, "shape": shape, "gazetteer": known, "context": context, "touch": touch}


#: What the classifier sees besides votes and kind.
FEATURES = ["grouped", "long", "digit_before", "starts"]


def _features(x: Column) -> dict[str, Column]:
    return {
        "grouped": x["text"].rlike("[ ()-]"),
        "long": F.length(x["text"]) > 19,
        "digit_before": x["before"].rlike(r"[0-9][^\p{L}\p{N}]{0,3}$"),
        "starts": x["before"].rlike(r"(?:^|[\r\n])\s*$"),
    }


def candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns but the text, and spans: kind, start, end, whether base, votes and features of every span."""
    # frames of few columns one upon the other, as a long expression would be repeated where it is used twice
    own = "_t"
    frame = docs.withColumn(own, F.coalesce(F.col(text_col), F.lit("")))
    frame = frame.select(*(c for c in docs.columns if c != text_col), own, *(matches(F.col(own), BASE[k], _NEEDS[k]).alias(f"_{k}") for k in KINDS))
    for k in KINDS:
        frame = frame.withColumn(f"_{k}", F.filter(f"_{k}", lambda x: valid(k, x["text"])))
    frame = frame.withColumn("_m", F.col(own))
    for k in KINDS:
        frame = frame.withColumn("_m", F.when(F.size(f"_{k}") > 0, blanked(F.col("_m"), BASE[k], lambda h: valid(k, h))).otherwise(F.col("_m")))
    for k, pattern in LOOSE.items():
        frame = frame.withColumn(f"_more_{k}", matches(F.col("_m"), pattern, _NEEDS_LOOSE[k]))
        frame = frame.withColumn("_m", F.when(F.size(f"_more_{k}") > 0, blanked(F.col("_m"), pattern, lambda h: F.lit(True))).otherwise(F.col("_m")))

    def seen(kind: int, base: bool) -> Callable[[Column], Column]:
        name = KINDS[kind]

        def row(x: Column) -> Column:
            votes, more = _votes(name, x), _features(x)
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), *(v.cast("int").alias(n) for n, v in votes.items()), *(v.cast("int").alias(n) for n, v in more.items()))

        return row

    spans = F.concat(*(F.transform(f"_{k}", seen(i, True)) for i, k in enumerate(KINDS)), *(F.transform(f"_more_{k}", seen(KINDS.index(k), False)) for k in LOOSE))
    return frame.select(*(c for c in docs.columns if c != text_col), spans.alias("spans"))


def posterior(rates: dict[str, tuple[float, float]], base: dict[int, float]) -> Column:
    """How likely a span is personal data, by its votes: ``rates`` has P(yes | true) and P(yes | false) of each labeler that votes."""
    prior = F.lit(0.5)
    for kind, p in base.items():
        prior = F.when(F.col("kind") == kind, p).otherwise(prior)
    odds = F.log(prior / (1 - prior))
    for name, (t, f) in rates.items():
        odds = odds + F.when(F.col(name) > 0, F.log(F.lit(t / f))).when(F.col(name) < 0, F.log(F.lit((1 - t) / (1 - f)))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, tuple[float, float]], dict[int, float]]:
    """Reliabilities by expectation-maximisation; ``patterns`` has kind, votes and n, the number of spans that have them.

    A round is one aggregate over the patterns, of which there are at most as many as
    there are combinations of votes. The priors keep a labeler that hardly ever votes,
    or votes one way only, from taking any value.
    """
    rates = {n: (p, 1 - p) for n, p in PRIOR.items()}
    base = dict.fromkeys(range(len(KINDS)), 0.5)
    for _ in range(rounds):
        p = posterior(rates, base)
        held = patterns.withColumn("p", p)
        sums = [F.sum(F.when(F.col(n) != 0, F.col("n") * w)).alias(f"{n}_{c}_all") for n in LABELERS for c, w in (("t", F.col("p")), ("f", 1 - F.col("p")))]
        sums += [F.sum(F.when(F.col(n) > 0, F.col("n") * w)).alias(f"{n}_{c}_yes") for n in LABELERS for c, w in (("t", F.col("p")), ("f", 1 - F.col("p")))]
        sums += [F.sum(F.when(F.col("kind") == k, F.col("n") * w)).alias(f"kind_{k}_{c}") for k in base for c, w in (("t", F.col("p")), ("n", F.lit(1.0)))]
        got = held.agg(*sums).first().asDict()
        value = lambda name: got[name] or 0.0  # noqa: B023, E731
        for n, start in PRIOR.items():
            t = (value(f"{n}_t_yes") + start * PRIOR_VOTES) / (value(f"{n}_t_all") + PRIOR_VOTES)
            f = (value(f"{n}_f_yes") + (1 - start) * PRIOR_VOTES) / (value(f"{n}_f_all") + PRIOR_VOTES)
            rates[n] = (min(max(t, 1e-4), 1 - 1e-4), min(max(f, 1e-4), 1 - 1e-4))
        base = {k: (value(f"kind_{k}_t") + 1) / (value(f"kind_{k}_n") + 2) for k in base}
    return rates, base


@dataclass
class SpanModel:
    """Weights of the final classifier and what they were trained on."""

    weights: dict[str, float]
    bias: float
    rates: dict[str, tuple[float, float]]
    base: dict[int, float]

    def probability(self, x: Column) -> Column:
        z = F.lit(self.bias)
        for name, value in _inputs(lambda n: x[n]).items():
            z = z + value * self.weights[name]
        return 1 / (1 + F.exp(-z))


def _inputs(get: Callable[[str], Column]) -> dict[str, Column]:
    """The classifier's inputs: each labeler's yes and no, each kind, each feature."""
    out = {}
    for n in LABELERS:
        out[f"{n}_yes"] = (get(n) > 0).cast("double")
        out[f"{n}_no"] = (get(n) < 0).cast("double")
    out |= {f"kind_{k}": (get("kind") == i).cast("double") for i, k in enumerate(KINDS)}
    return out | {n: get(n).cast("double") for n in FEATURES}


def train(found: DataFrame) -> SpanModel | None:
    """The classifier of spans, from all spans of ``found``; None where there are none."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    seen = ["kind", *LABELERS, *FEATURES]
    flat = found.select(F.explode("spans").alias("x")).select(*(F.col(f"x.{n}").alias(n) for n in seen))
    # partial counts before the shuffle: a row for each combination
    patterns = cut(flat.groupBy(*seen).agg(F.count("*").cast("double").alias("n")).coalesce(1), "votes")
    if patterns.isEmpty():
        return None
    rates, base = estimate(patterns)
    soft = patterns.withColumn("p", posterior(rates, base))
    labelled = soft.withColumn("y", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("w", F.col("n") * F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))
    inputs = _inputs(F.col)
    rows = labelled.select("y", "w", *(v.alias(f"in_{n}") for n, v in inputs.items())).orderBy("y", "w", *(f"in_{n}" for n in inputs)).coalesce(1)
    rows = VectorAssembler(inputCols=[f"in_{n}" for n in inputs], outputCol="features").transform(rows)
    fitted = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1e-3, maxIter=50, standardization=False).fit(rows)
    return SpanModel(dict(zip(inputs, map(float, fitted.coefficients.toArray()))), float(fitted.intercept), rates, base)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, SpanModel | None]:
    """Rows (id, spans) with an array of (kind, start, end, base), ordered by kind and start, and the classifier.

    Positions are of code points, the end exclusive. Base spans are what the exact
    rules find, each kind for itself; a candidate from what they leave is added where
    the classifier gives it ``threshold`` or more. Added spans overlap neither each
    other nor a base span that lies outside another one. One row for each row of
    ``docs``: repeated rows and null ids are documents of their own, null and empty
    texts have no spans, an empty table has no rows; other columns, whatever their
    names, are ignored.
    """
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = cut(candidates(plain, "_text"), "spans")
    model = train(found)
    chosen = lambda x: x["base"] | (model.probability(x) >= threshold) if model else x["base"]
    slim = F.transform(F.filter("spans", chosen), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    return found.select(F.col("_id").alias(id_col), F.array_sort(slim).alias("spans")), model


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and hash are of base spans, ``spans`` has all."""
    rows, _ = find_personal_data(docs, id_col, text_col)
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == i))).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("long")
    return rows.select(id_col, *counts, F.sha2(text(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), added.alias("n_added"))
