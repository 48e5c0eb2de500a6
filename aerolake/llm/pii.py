"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates. Base kinds (email, ip, card, phone) are matched leftmost and without overlap; matches that fail their test are
dropped, not retried. Further candidates: addresses spelled with (at) and (dot), phone numbers without a plus, social
security numbers, bank account numbers (IBAN), names after a title, and access tokens and keys.

Votes. Labelers look at a candidate and its surroundings and vote for (1), against (-1) or abstain (0): the strict form, a
checksum or range, a gazetteer (top-level domains, card issuers, calling codes, given names), context words in the ``BEFORE``
code points before it, and its edges. Surroundings are cut from the text by offsets, whatever stands there.

Model. All candidates of all documents are counted by (kind, votes, shape); the counts, at most kinds x 3^5 x shapes rows whatever
the data, go to the driver, where expectation-maximisation estimates each labeler's reliability from the votes without gold
labels. Its posteriors train the final span classifier, a logistic regression over kind, votes, their products and the shape of
the span (length, marks, repeated digits), which is applied as a column expression. Base spans stay whatever it says; others
are added if it accepts them and they overlap no base span.

Patterns are written so that they cannot backtrack over long runs: possessive repeats, and starts only where a run starts. Places,
overlaps and surroundings of the spans of a text take time in proportion to text and spans: sums run chunk by chunk.

Defined cases: null text is empty; empty text has no spans; very long texts are read whole; equal rows give equal rows; an empty
table gives an empty table; columns of the input are kept by ``redact`` and play no part otherwise. Offsets count code points, end
exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import free_name, identity, materialise, read_table, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("spelled_email", "local_phone", "ssn", "iban", "person", "secret")
KINDS = BASE + ADDED

_MAIL = "A-Za-z0-9._%+-"
#: kind: (what a text must contain, pattern)
PATTERNS = {
    "email": ("@", rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "spelled_email": ("at", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[a-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]++)++"),
    "local_phone": ("", r"(?<![0-9+.-])(?<![+0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": ("", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
    "person": (". ", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]++(?: [A-Z][a-z]++)?+"),
    "secret": ("", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+"),
}
#: Code points before and after a candidate that labelers see.
BEFORE, AFTER = 40, 4
#: Words that make personal data likely when they stand before it.
CONTEXT = "mail|contact|write to|reach|call|phone|tel|fax|mobile|whatsapp|dial|card|visa|credit|account|iban|ssn|social security|ip|address|host|server|login|from|token|secret|key|password|passwd|auth"
#: Generic and country top-level domains, leading digits of card issuers, country calling codes of one and two digits
#: and the first two digits of those of three.
TOP_DOMAINS = "com org net edu gov mil int info biz name pro io app dev ai me tv co eu us uk ca mx br ar cl pe de at ch fr be nl lu it es pt ie dk se no fi is pl cz sk hu ro bg gr tr ru ua rs hr si ee lv lt il sa ae eg ma ng ke za in pk bd lk cn hk tw jp kr sg my th vn id ph au nz".split()
CARD_ISSUERS = "4 51 52 53 54 55 34 37 36 38 6011 65 35 22 23 24 25 26 27".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CALLING_AREAS = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
#: Common given names of four languages, and words after a title that name a brand or a figure.
GIVEN_NAMES = "Adam Alan Alex Alice Amy Andrea Andrew Angela Ann Anna Anne Anthony Antonio Barbara Ben Bernard Brian Carl Carlos Carmen Carol Catherine Charles Charlotte Chris Christian Christine Claire Claudia Daniel David Diana Donald Edward Elena Elizabeth Emily Emma Eric Eva Florian Francis Francisco Frank George Hannah Hans Helen Henry Ines Isabel Jack Jacques Jakob James Jan Jane Javier Jean Jennifer Jessica Joan John Jorge Jose Joseph Juan Julia Julie Karen Karl Kate Kevin Klaus Laura Lena Linda Lisa Louis Lucas Lucia Luis Manuel Marc Maria Marie Mark Martin Mary Matthew Max Michael Michel Miguel Monica Nancy Nicolas Nina Olivia Oscar Pablo Patricia Paul Pedro Peter Philip Pierre Rachel Richard Robert Rosa Ruth Samuel Sandra Sarah Simon Sofia Sophie Stefan Stephen Steven Susan Thomas Tim Victor Walter William".split()
NO_NAMES = "Pepper Martens Oetker Who Strange Evil Doom No Bean Clean Fix Right Wrong Wonderful Universe World Olympia President Speaker Chairman Justice".split()
LABELERS = ("form", "check", "gazetteer", "context", "edges")
SHAPES = {"size": 4, "marks": 4, "same": 2}  # values of each feature of a span's shape
SPAN = "array<struct<kind:string,start:bigint,stop:bigint,match:string>>"
EM_STEPS = 60
#: Items of an array that one running sum goes over, and code points of a piece of text.
RUN, PIECE = 128, 512


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, zero: int, join: Callable[[Column, Column], Column]) -> Column:
    """For each item of array<bigint>, what ``join`` makes of all items before it; in runs, so that no long array is copied per item."""
    nought, none = F.lit(zero).cast("bigint"), F.array().cast("array<bigint>")

    def one(items: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def by_runs(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda i: F.slice(v, i * RUN + 1, RUN))
        return let(runs, lambda r: F.flatten(F.zip_with(r, one(F.transform(r, lambda x: F.aggregate(x, nought, join)), nought), one)))

    return let(values, lambda v: F.when(F.size(v) > 0, by_runs(v)).otherwise(none))


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(parts: Column, start: Column, stop: Column) -> Column:
    """Text from start to stop, out of its pieces; reads those it touches only."""
    first = F.floor(start / PIECE).cast("int")
    touched = F.slice(parts, first + 1, F.greatest(F.floor((stop - 1) / PIECE).cast("int") - first + 1, F.lit(0)))
    return F.substring(F.array_join(touched, ""), (start - F.lit(PIECE) * first + 1).cast("int"), (stop - start).cast("int"))


def found(text: Column, kind: str) -> Column:
    """All matches of a kind with offsets: matches and the gaps between them have the same order, so lengths add up to places."""
    needed, pattern = PATTERNS[kind]
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def spans(x: Column) -> Column:
        lengths = F.zip_with(x["m"], F.slice(x["g"], 1, F.size(x["m"])), lambda m, g: F.struct(m.alias("m"), F.length(g).cast("bigint").alias("gap")))
        ends = running(F.transform(lengths, lambda y: y["gap"] + F.length(y["m"])), 0, lambda a, b: a + b)
        return F.zip_with(lengths, ends, lambda y, at: F.struct(F.lit(kind).alias("kind"), (at + y["gap"]).alias("start"), (at + y["gap"] + F.length(y["m"])).alias("stop"), y["m"].alias("match")))

    has = F.contains(text, F.lit(needed)) & text.rlike(pattern) if needed else text.rlike(pattern)
    return F.when(has, let(both, spans)).otherwise(F.array().cast(SPAN))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn test?"""
    places = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """The test that a match of a base kind must pass; true for other kinds."""
    n = F.length(digits(match))
    parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    octets = F.forall(parts, lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= F.lit("255")))
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", n.between(12, 19) & F.when(n.between(12, 19), luhn(digits(match))).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def mod_97(match: Column) -> Column:
    """Do the check digits of an IBAN fit? Country and check digits go last, letters count from 10."""
    plain = F.regexp_replace(match, " ", "")
    codes = F.transform(F.split(F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4))), ""), lambda c: F.when(c.rlike("^[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int")))
    return F.aggregate(codes, F.lit(0), lambda a, x: F.when(x.isNull(), a).when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97)) == 1


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: Column, match: Column, before: Column, after: Column) -> Column:
    """The labelers' votes on a candidate, a struct of -1, 0 and 1."""
    n, d = F.length(digits(match)), digits(match)
    is_ = lambda *kinds: kind.isin(*kinds)
    strict = (
        F.when(is_("email"), match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}$"))
        .when(is_("ip"), match.rlike(r"^[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}$"))
        .when(is_("card"), match.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3})$"))
        .when(is_("phone"), match.rlike(r"^\+[1-9][0-9]{0,2}[ .-]?(\([0-9]{1,4}\)|[0-9]{1,4})[ .-]?[0-9]{2,4}([ .-]?[0-9]{2,4}){0,3}$"))
        .when(is_("person"), match.rlike(r"^[A-Z][a-z]+\. [A-Z][a-z]+ [A-Z][a-z]+$"))
        .when(is_("secret"), match.rlike(r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]{20,})$"))
        .otherwise(F.lit(True))
    )
    checked = (
        F.when(is_("card"), n.between(13, 19) & F.when(n.between(12, 19), luhn(d)).otherwise(F.lit(False)))
        .when(is_("phone", "local_phone"), n.between(10, 15))
        .when(is_("ip"), valid(kind, match) & ~match.rlike(r"^(0|10|127|255)\."))
        .when(is_("ssn"), ~match.rlike(r"^(000|666|9)|-00-|-0000$"))
        .when(is_("iban"), mod_97(match))
        .when(is_("secret"), F.size(F.array_distinct(F.split(match, ""))) >= 10)
    )
    domain = F.lower(F.regexp_extract(match, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    name = F.regexp_extract(match, r"\. ([A-Z][a-z]+)", 1)
    listed = (
        F.when(is_("email", "spelled_email"), domain.isin(TOP_DOMAINS))
        .when(is_("card"), F.exists(F.array(*map(F.lit, CARD_ISSUERS)), lambda p: F.startswith(d, p)))
        .when(is_("phone"), F.left(d, F.lit(1)).isin(CALLING_CODES) | F.left(d, F.lit(2)).isin(CALLING_CODES + CALLING_AREAS))
        .when(is_("person") & name.isin(GIVEN_NAMES), F.lit(True))
        .when(is_("person") & name.isin(NO_NAMES), F.lit(False))
    )
    cue = F.lower(before).rlike(rf"(?:{CONTEXT})[^a-z0-9]*(?:[a-z0-9]+[^a-z0-9]+){{0,6}}$")
    open_before = ~before.rlike(r"[\p{L}0-9_/=@.-]$")
    open_after = ~after.rlike(r"^[\p{L}0-9_/=@-]")
    return F.struct(
        _vote(strict, ~strict).alias("form"),
        _vote(F.coalesce(checked, F.lit(False)), F.coalesce(~checked, F.lit(False))).alias("check"),
        _vote(F.coalesce(listed, F.lit(False)), F.coalesce(~listed, F.lit(False))).alias("gazetteer"),
        _vote(cue, F.lit(False)).alias("context"),
        _vote(open_before & open_after, ~(open_before & open_after)).alias("edges"),
    )


def shape(match: Column) -> Column:
    """Length, marks and repeated digits of a span, in SHAPES values each."""
    size = F.when(F.length(match) < 12, 0).when(F.length(match) < 16, 1).when(F.length(match) < 24, 2).otherwise(3)
    marks = F.least(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), F.lit(3))
    return F.struct(size.alias("size"), marks.alias("marks"), match.rlike(r"([0-9])\1{5}").cast("int").alias("same"))


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``spans``: base matches that pass, and all other candidates, each with votes and shape."""
    text = text_or_empty()

    def seen(spans: Column) -> Column:
        def one(parts: Column) -> Column:
            before = lambda s: between(parts, F.greatest(s["start"] - BEFORE, F.lit(0)), s["start"])
            after = lambda s: between(parts, s["stop"], s["stop"] + AFTER)
            return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), votes(s["kind"], s["match"], before(s), after(s)).alias("votes"), shape(s["match"]).alias("shape")))

        return let(F.when(F.size(spans) > 0, pieces(text)).otherwise(F.array().cast("array<string>")), one)

    passed = F.filter(F.concat(*(found(text, k) for k in KINDS)), lambda s: valid(s["kind"], s["match"]))
    return docs.select(*keep, let(passed, seen).alias("spans"))


Votes = tuple[int, ...]


def em(counts: list[tuple[str, Votes, int]], steps: int = EM_STEPS) -> list[float]:
    """Posterior that a candidate is personal data for each (kind, votes, count); two classes, labelers independent given the class.

    Reliabilities are shared by all kinds, the prior is each kind's own; both start from, and are smoothed towards, labelers
    that are right more often than not.
    """
    m = len(LABELERS)
    right = [{c: {v: (0.6 if v == c else 0.15 if v else 0.25) for v in (-1, 0, 1)} for c in (-1, 1)} for _ in range(m)]
    prior = {k: 0.7 for k, _, _ in counts}
    post = [0.5] * len(counts)
    for _ in range(steps):
        for i, (kind, vote, _) in enumerate(counts):
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for j in range(m):
                yes += math.log(right[j][1][vote[j]])
                no += math.log(right[j][-1][vote[j]])
            post[i] = 1 / (1 + math.exp(max(-500.0, min(500.0, no - yes))))
        for j in range(m):
            for c in (-1, 1):
                mass = {v: 60 * (0.6 if v == c else 0.15 if v else 0.25) for v in (-1, 0, 1)}
                for (_, vote, n), p in zip(counts, post, strict=True):
                    mass[vote[j]] += n * (p if c == 1 else 1 - p)
                total = sum(mass.values())
                right[j][c] = {v: x / total for v, x in mass.items()}
        for kind in prior:
            n = sum(x for k, _, x in counts if k == kind)
            s = sum(x * p for (k, _, x), p in zip(counts, post, strict=True) if k == kind)
            prior[kind] = (s + 7) / (n + 10)
    return post


def features(kind: str, vote: Votes, form: Votes) -> list[float]:
    shapes = [float(v == x) for v, n in zip(form, SHAPES.values(), strict=True) for x in range(1, n)]
    return [1.0, *(float(kind == k) for k in KINDS), *(float(v) for v in vote), *(float(a * b) for i, a in enumerate(vote) for b in vote[:i]), *shapes]


def train(counts: list[tuple[str, Votes, Votes, int]], post: list[float], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of the span classifier, by gradient descent on the posteriors over the counted (kind, votes, shape, count)."""
    rows = [([(i, x) for i, x in enumerate(features(k, v, f)) if x], math.log1p(n), p) for (k, v, f, n), p in zip(counts, post, strict=True)]
    w = [0.0] * len(features(KINDS[0], (0,) * len(LABELERS), (0,) * len(SHAPES)))
    total = sum(n for _, n, _ in rows) or 1.0
    for _ in range(steps):
        grad = [decay * x for x in w]
        for x, n, p in rows:
            z = sum(w[i] * a for i, a in x)
            d = (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - p) * n / total
            for i, a in x:
                grad[i] += d * a
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def score(span: Column, w: list[float]) -> Column:
    """The classifier's log-odds of a candidate."""
    v = [span["votes"][name] for name in LABELERS]
    given = [F.lit(1.0), *(F.when(span["kind"] == k, 1.0).otherwise(0.0) for k in KINDS), *v, *(a * b for i, a in enumerate(v) for b in v[:i])]
    given += [F.when(span["shape"][name] == x, 1.0).otherwise(0.0) for name, n in SHAPES.items() for x in range(1, n)]
    total = F.lit(0.0)
    for a, x in zip(w, given, strict=True):
        total = total + F.lit(a) * x
    return total


def model(candidates_: DataFrame) -> list[float]:
    """Classifier weights from the candidates' votes: EM over counts by (kind, votes), training over counts by shape too."""
    names = [*(f"votes.{n}" for n in LABELERS), *(f"shape.{n}" for n in SHAPES)]
    every = candidates_.filter(F.size("spans") > 0).select(F.explode("spans").alias("s")).select("s.kind", *(F.col(f"s.{n}").alias(n.replace(".", "_")) for n in names))
    m = len(LABELERS)
    rows = sorted((r[0], tuple(r[1 : 1 + m]), tuple(r[1 + m : -1]), r[-1]) for r in every.groupBy(*every.columns).count().collect())  # kinds x votes x shapes at most
    if not rows:
        return [0.0] * len(features(KINDS[0], (0,) * m, (0,) * len(SHAPES)))
    by_votes: dict[tuple[str, Votes], int] = {}
    for kind, vote, _, n in rows:
        by_votes[kind, vote] = by_votes.get((kind, vote), 0) + n
    post = dict(zip(by_votes, em([(*k, n) for k, n in by_votes.items()]), strict=True))
    return train(rows, [post[kind, vote] for kind, vote, _, _ in rows])


def label(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``spans`` array<struct<kind, start, stop, base>>: base spans and accepted further ones, by start, then kind."""
    found_ = materialise(candidates(docs, keep), "pii-candidates")  # spans only: the texts are read once
    w = model(found_)
    order = F.array(*map(F.lit, KINDS))
    is_base = lambda s: s["kind"].isin(*BASE)
    plain = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("order"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    accepted = F.filter("spans", lambda s: is_base(s) | (score(s, w) > 0))
    far = 1 << 62

    def free(every: Column) -> Column:
        """Base spans, and those that no base span before them reaches into or after them begins in."""
        reach = running(F.transform(every, lambda s: F.when(is_base(s), s["stop"]).otherwise(F.lit(0).cast("bigint"))), 0, lambda a, b: F.greatest(a, b))
        ahead = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(is_base(s), s["start"]).otherwise(F.lit(far).cast("bigint")))), far, lambda a, b: F.least(a, b)))
        both = F.zip_with(every, F.zip_with(reach, ahead, lambda a, b: F.struct(a.alias("reach"), b.alias("ahead"))), lambda s, x: F.struct(s.alias("s"), x.alias("x")))
        kept = F.filter(both, lambda y: is_base(y["s"]) | (y["x"]["reach"] <= y["s"]["start"]) & (y["x"]["ahead"] >= y["s"]["stop"]))
        return F.transform(kept, lambda y: F.struct(y["s"]["kind"].alias("kind"), y["s"]["start"].alias("start"), y["s"]["stop"].alias("stop"), is_base(y["s"]).alias("base")))

    return found_.select(*keep, let(F.array_sort(F.transform(accepted, plain)), free).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; n_chars follows where it exists. Null text stays null."""
    named, found_in = free_name(docs, "_key"), free_name(docs, "_found")
    key = identity("doc_id", "text")
    spans = label(docs.select("text", key.alias(named)), [named]).filter(F.size("spans") > 0).dropDuplicates([named])
    both = docs.withColumn(named, key).join(spans.withColumnRenamed("spans", found_in), named, "left")

    def clean(x: Column) -> Column:
        """``x``: spans by start, and the text's pieces. What stands between spans, each span's kind, and what follows the last."""
        reach = running(F.transform(x["spans"], lambda s: s["stop"]), 0, lambda a, b: F.greatest(a, b))
        parts = F.zip_with(x["spans"], reach, lambda s, at: F.when(s["start"] >= at, F.concat(between(x["parts"], at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        last = F.array_max(F.transform(x["spans"], lambda s: s["stop"]))
        return F.concat(F.array_join(parts, ""), between(x["parts"], last, F.length("text").cast("bigint")))

    text = F.when(F.col(found_in).isNull() | F.col("text").isNull(), F.col("text")).otherwise(let(F.struct(F.col(found_in).alias("spans"), pieces(F.col("text")).alias("parts")), clean))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found_in).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = label(read_table(spark, sf_dir, "documents"), ["doc_id"])
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["base"])
    return docs.select("doc_id", *map(of, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op2_pii": op2_pii}
