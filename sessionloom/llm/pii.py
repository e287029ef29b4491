"""Personal data by weak supervision, in DataFrame functions throughout.

Four labelers vote on every candidate span: a *pattern* labeler (checks of form: check digits, lengths of issuers, parts that may not occur), a *gazetteer* labeler
(top-level domains, issuers, calling codes, address ranges, account lengths by country, given names, key prefixes, well-known examples), a *context* labeler (words before the span that speak for
or against personal data) and an *edge* labeler (the span is or isn't cut out of a longer word or number).  Expectation-maximisation
estimates for each kind how often personal data occurs and how reliable each labeler is, and gives each pattern of votes
a probability.  A logistic span classifier is trained on these and decides.

The base spans (e-mail, IP, card and phone in strict format) are always reported; the classifier adds loose candidates:
bracketed mail addresses, telephone numbers without a country code, secrets, account and social-security numbers and titled names.

Everything that is estimated comes from counts of vote patterns over all documents: a table of bounded size (kinds x votes x
length classes), folded by higher-order functions in one expression.  Documents are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import table, written

MARK = "\u0001"
KINDS = ["email", "ip", "card", "phone", "secret", "iban", "ssn", "name"]
BASE = 4
CONTEXT_CHARS = 40
LABELERS = 4
EM_ROUNDS = 25
FIT_ROUNDS = 300
THRESHOLD = 0.5

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> strict pattern.  Possessive quantifiers stand where the greedy ones can't gain by giving back; they keep long runs off
#: the stack.  The look-behinds start a match at the first character of a run, where the leftmost match must start.
STRICT = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd)\b[\x20\"']{0,3}[:=][\x20\"']{0,3}[A-Za-z0-9_/+=.-]{8,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{L}+(?:\x20\p{Lu}\p{L}+)?",
}
#: A cheap test that every match implies.
GUARD = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.regexp_like(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.regexp_like(t, F.lit("[0-9][0-9 -]{8}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
LOOSE_GUARD = {
    "email": lambda t: F.regexp_like(t, F.lit(r"[\[(](?:at|AT)[\])]")),
    "phone": lambda t: F.regexp_like(t, F.lit("[0-9][0-9][0-9][ .-][0-9][0-9][0-9][0-9]")),
    "secret": lambda t: F.regexp_like(t, F.lit("[:=]")),
    "iban": lambda t: F.regexp_like(t, F.lit("[A-Z][A-Z][0-9][0-9]")),
    "ssn": lambda t: F.regexp_like(t, F.lit("[0-9]-[0-9][0-9]-[0-9]")),
    "name": lambda t: F.regexp_like(t, F.lit(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}")),
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
# Lists that the gazetteer labeler looks up.
TLDS = "com org net edu gov info biz io eu de fr es it nl pl uk us ca au ch at be br mx jp cn in ru se no dk fi pt ie nz za ar cl co kr".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 212 213 216 234 254 351 352 353 358 359 370 371 372 380 385 386 420 421 852 880 886 966 971 972".split()
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
GIVEN_NAMES = "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel lisa anna maria peter paul hans klaus karl heinz jürgen ursula monika sabine andrea stefan jean pierre marie jacques michel philippe françoise isabelle nathalie josé juan antonio carmen pedro luis ana laura sofia jane emma".split()
KEY_PREFIXES = ["sk-", "sk_live_", "rk_live_", "AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-"]
EXAMPLES = {
    "email": r"(?i)@(?:example|test|domain|invalid)\.|^(?:no-?reply|user|name)@",
    "ip": r"^(?:0|127|255|22[4-9]|2[34][0-9])\.|^192\.0\.2\.|^198\.51\.100\.|^203\.0\.113\.",
    "card": r"^4111[ -]?1111[ -]?1111[ -]?1111$|^4242[ -]?4242",
    "phone": r"555[ .-]?01[0-9]{2}$",
    "secret": r"(?i)example|change.?me|your|placeholder|dummy|x{4}|\*{4}|1234|password$",
    "iban": r"(?!)",
    "ssn": r"^(?:078-05-1120|219-09-9999|123-45-6789|987-65-432[0-9])$",
    "name": r"(?!)",
}
_TLD = rf"(?i)[.)\]]\x20?(?:{'|'.join(TLDS)})$"
GAZETTEER = {
    "email": _TLD,
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|35|6)",
    "phone": rf"^(?:\+\x20?(?:{'|'.join(CALLING)})|\(?[2-9][0-8][0-9])",
    "secret": rf"[:=][\x20\"']{{0,3}}(?:{'|'.join(KEY_PREFIXES)})",
    "iban": "|".join(rf"^{c}(?:\x20?[A-Z0-9]){{{n - 2}}}$" for c, n in IBAN_LENGTHS.items()),
    "ssn": r"(?!)",
    "name": rf"(?iu)\x20(?:{'|'.join(GIVEN_NAMES)})(?:\x20|$)",
}
#: Where a form that is not in the gazetteer speaks against the span, and not only not for it.
CLOSED = frozenset(["email", "ip", "card", "phone", "iban"])
#: Forms that a span's own check asks for.
FORM = {
    "email": r"[.)\]]\x20?[A-Za-z]{2,}$",
    "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$",
    "card": r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|35[0-9]{14}|6[0-9]{15,18})$",
    "phone": r"^[0-9]{10,13}$",
    "secret": r"[:=][\x20\"']{0,3}(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z]).{16,}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "name": r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$",
}
FOR = r"(?i)(?:e-?mail|mail(?:to)?|contact|phone|tel|call|mobile|fax|card|visa|credit|ip|address|host|client|token|key|secret|passw|login|account|iban|bank|ssn|social|name|signed|dear)\W{0,12}\w*\W{0,3}$"
AGAINST = r"(?i)(?:version|release|isbn|issn|doi|invoice|order|ref|serial|build|page|section|figure|rfc)\W{0,6}$"
_SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _matches(t: Column, pattern: str, guard: Column) -> Column:
    """start, end (code points), text, 40 characters before and one after, of each match from the left."""
    parts = F.split(F.regexp_replace(t, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")), MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit("").alias("prev"), F.array().cast(_SPAN).alias("out"))

    def step(p: Column):
        def f(s: Column, x: Column) -> Column:
            span = F.struct(
                s["at"].alias("start"),
                (s["at"] + F.length(x)).alias("end"),
                x.alias("text"),
                s["prev"].alias("before"),
                F.left(F.get(p, s["i"] + 1), F.lit(1)).alias("after"),
            )
            out = F.when(s["i"] % 2 == 1, F.concat(s["out"], F.array(span))).otherwise(s["out"])
            return F.struct((s["at"] + F.length(x)).alias("at"), (s["i"] + 1).alias("i"), F.right(x, F.lit(CONTEXT_CHARS)).alias("prev"), out.alias("out"))

        return f

    found = F.get(F.transform(F.array(parts), lambda p: F.aggregate(p, start, step(p), lambda s: s["out"])), F.lit(0))  # the parts are made once
    return F.when(guard, found).otherwise(F.array().cast(_SPAN))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check-digit test."""
    back = F.split(F.reverse(digits), "")
    weighed = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("[^0-9]+"), F.lit(""))


def _valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    return {
        "email": F.lit(True),
        "ip": F.regexp_like(text, F.lit(OCTETS)),
        "card": n.between(12, 19) & luhn(_digits(text)),
        "phone": n.between(9, 15),
    }[kind]


def _valid_only(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["text"]))


def iban_remainder(text: Column) -> Column:
    """The remainder by 97 of an account number with its first four characters behind and letters as 10 to 35; 1 if its check digits fit."""
    flat = F.regexp_replace(text, F.lit("[^A-Z0-9]"), F.lit(""))
    turned = F.split(F.concat(F.substring(flat, 5, 64), F.left(flat, F.lit(4))), "")
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)))
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(c >= "A", 100).when(c == "", 1).otherwise(10) + value(c)) % 97)


def _votes(kind: str, s: Column) -> Column:
    """The four votes: 1 for, -1 against, 0 none."""
    t = s["text"]
    if kind == "iban":
        form = F.when(iban_remainder(t) == 1, 1).otherwise(-1)
    else:
        form = F.when(F.regexp_like(_digits(t) if kind in ("card", "phone") else t, F.lit(FORM[kind])), 1).otherwise(-1)
    gazetteer = F.when(F.regexp_like(t, F.lit(EXAMPLES[kind])), -1).when(F.regexp_like(t, F.lit(GAZETTEER[kind])), 1).otherwise(-1 if kind in CLOSED else 0)
    context = F.when(F.regexp_like(s["before"], F.lit(FOR)), 1).when(F.regexp_like(s["before"], F.lit(AGAINST)), -1).otherwise(0)
    edge = F.when(F.regexp_like(s["before"], F.lit(r"[\p{L}\p{N}_]$")) | F.regexp_like(s["after"], F.lit(r"^[\p{L}\p{N}_]")), -1).otherwise(1)
    return F.array(form, gazetteer, context, edge)


def _candidates_of(kind: str, spans: Column, base: bool) -> Column:
    def one(s: Column) -> Column:
        n = F.length(s["text"])
        size = F.when(n < 12, 0).when(n < 24, 1).otherwise(2)
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.lit(base).alias("base"), _votes(kind, s).alias("votes"), size.alias("size"))

    return F.transform(spans, one)


def candidates(text: Column) -> Column:
    """The base spans and loose candidates of a text: array of (start, kind, end, base, votes, size).

    Strict matches that fail their check are dropped.
    A null text has none.
    """
    t = F.translate(F.coalesce(text, F.lit("")), MARK, "\u0002")
    out = []
    for kind, pattern in STRICT.items():
        spans = _valid_only(kind, _matches(t, pattern, GUARD[kind](t)))
        out.append(_candidates_of(kind, spans, True))
    for kind, pattern in LOOSE.items():
        spans = _matches(t, pattern, LOOSE_GUARD[kind](t))
        out.append(_candidates_of(kind, spans, False))
    return F.concat(*out)


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier: one for each kind, then for and against of each labeler, then the length classes."""

    weights: tuple[float, ...]

    def probability(self, s: Column) -> Column:
        w = self.weights
        k = len(KINDS)
        z = F.get(F.array(*map(F.lit, w[:k])), s["kind"])
        for i in range(LABELERS):
            v = F.get(s["votes"], F.lit(i))
            z = z + F.when(v > 0, w[k + 2 * i]).when(v < 0, w[k + 2 * i + 1]).otherwise(0.0)
        z = z + F.get(F.array(*map(F.lit, w[k + 2 * LABELERS :])), s["size"])
        return 1 / (1 + F.exp(-z))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _em(patterns: Column) -> Column:
    """patterns: array of (kind, votes, size, n) -> the probability of each, by expectation-maximisation."""
    prior = lambda x: 1 / (1 + F.exp(-1.5 * F.aggregate(x["votes"], F.lit(0.0), lambda a, v: a + v) - 0.5))

    def round_(p: Column, _: Column) -> Column:
        both = F.zip_with(patterns, p, lambda x, q: F.struct(x["kind"].alias("kind"), x["votes"].alias("votes"), (x["n"] * q).alias("yes"), (x["n"] * (1 - q)).alias("no")))

        def of(rows: Column, x: Column) -> Column:
            same = F.get(F.transform(F.array(F.filter(rows, lambda r: r["kind"] == x["kind"])), lambda r: r), F.lit(0))

            def odds(own: Column) -> Column:
                yes, no = _sum(F.transform(own, lambda r: r["yes"])) + 1, _sum(F.transform(own, lambda r: r["no"])) + 1
                z = F.log(yes / no)
                for i in range(LABELERS):
                    with_vote = lambda field, i=i: _sum(F.transform(F.filter(own, lambda r: F.get(r["votes"], F.lit(i)) == F.get(x["votes"], F.lit(i))), lambda r: r[field]))  # noqa: E731, B023
                    # labelers are a priori better than chance: one observation of that kind each
                    v = F.get(x["votes"], F.lit(i))
                    z = z + F.log((with_vote("yes") + F.when(v > 0, 2.0).otherwise(1.0)) / (yes + 3)) - F.log((with_vote("no") + F.when(v < 0, 2.0).otherwise(1.0)) / (no + 3))
                return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))

            return F.get(F.transform(F.array(same), odds), F.lit(0))

        return F.get(F.transform(F.array(both), lambda rows: F.transform(patterns, lambda x: of(rows, x))), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), F.transform(patterns, prior), round_)


def _inputs(x: Column) -> Column:
    """The classifier's inputs of a vote pattern."""
    kinds = [(x["kind"] == k).cast("double") for k in range(len(KINDS))]
    votes = [c.cast("double") for i in range(LABELERS) for v in [F.get(x["votes"], F.lit(i))] for c in (v > 0, v < 0)]
    sizes = [(x["size"] == k).cast("double") for k in range(3)]
    return F.array(*kinds, *votes, *sizes)


def _train(rows: Column) -> Column:
    """rows: array of (x, n, p) -> weights, by gradient descent on the expected labels with a small ridge."""
    width = len(KINDS) + 2 * LABELERS + 3
    dot = lambda a, b: _sum(F.zip_with(a, b, lambda u, v: u * v))

    def round_(w: Column, _: Column) -> Column:
        errors = F.transform(rows, lambda r: r["n"] * (1 / (1 + F.exp(-dot(w, r["x"]))) - r["p"]))

        def step(e: Column) -> Column:
            total = F.greatest(_sum(F.transform(rows, lambda r: r["n"])), F.lit(1.0))
            return F.transform(w, lambda old, f: old - 2.0 * (_sum(F.zip_with(rows, e, lambda r, y: y * F.get(r["x"], f))) / total + 1e-4 * old))

        return F.get(F.transform(F.array(errors), step), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), F.array_repeat(F.lit(0.0), width), round_)


def fit(spans: DataFrame) -> SpanModel:
    """The span classifier from ``spans`` (a column ``candidates``): vote patterns are counted over all rows, the counts go to one
    row (kinds x votes x length classes at most) and that row to the weights."""
    each = spans.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.size")
    counts = each.groupBy("kind", "votes", "size").agg(F.count("*").cast("double").alias("n"))
    # patterns weigh by the root of their count, so that one kind with many spans doesn't drown the others
    row = counts.agg(F.sort_array(F.collect_list(F.struct("kind", "votes", "size", "n"))).alias("patterns"))
    row = written(row.select("patterns", _em(F.col("patterns")).alias("p")), "pii-patterns")
    rows = F.zip_with("patterns", "p", lambda x, p: F.struct(_inputs(x).alias("x"), F.sqrt(x["n"]).alias("n"), p.alias("p")))
    weights = row.select(rows.alias("rows")).select(_train(F.col("rows")).alias("w")).first()["w"]
    return SpanModel(tuple(weights))


def decided(found: Column, model: SpanModel, threshold: float = THRESHOLD) -> Column:
    """All spans (start, kind, end, base), by start and kind: the base spans, and the candidates that the classifier takes and
    that overlap no base span."""
    base = F.filter(found, lambda s: s["base"])
    more = F.filter(found, lambda s: ~s["base"] & (model.probability(s) >= threshold) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.array_sort(F.transform(F.concat(base, more), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))


def labelled(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of start, kind, end, base) of each row of ``docs`` (doc_id, text).

    Null and empty texts have no spans.  Repeated rows and null ids stay.  An empty table gives an empty result.  Matches cost
    time in proportion to the text, and the square of the matches in one text.  Other columns are not read.
    """
    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(F.col("text").cast("string")).alias("candidates")), "pii-candidates")
    model = fit(found)
    return found.select("doc_id", decided(F.col("candidates"), model).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        name = F.concat(F.lit("<"), F.get(F.array(*map(F.lit, KINDS)), x["kind"]), F.lit(">"))
        piece = F.when(x["start"] >= s["at"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), name)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], piece).alias("out"))

    end = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)


FOUND, TAKEN = "pii_mask_found", "pii_mask_taken"


def mask(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with the personal data in ``text`` masked.  Null texts stay null.

    Candidates are looked for once: they are written next to the rows, the model is fitted on them and they are read again.
    """
    found = written(docs.withColumn(FOUND, candidates(F.col("text"))), "pii-candidates")
    model = fit(found.select(F.col(FOUND).alias("candidates")).where(F.size("candidates") > 0))
    taken = found.withColumn(TAKEN, decided(F.col(FOUND), model))
    return taken.withColumn("text", masked(F.col("text"), F.col(TAKEN))).select(docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find``'s."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return found.select("doc_id", *counts, F.sha2(labelled(base).cast("binary"), 256).alias("base_sha256"), labelled(F.col("spans")).alias("spans"))


def op8_pii_weak_supervision(spark, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))


