"""Personal data by weak supervision, with DataFrame functions only.

Candidates are strict matches (e-mail, IP, card, phone), which are always kept,
and looser ones (spelled-out addresses, numbers in local form, names after a
title, identity and account numbers, assigned values that may be secrets),
which are not. Five labelers vote on
each: form, gazetteer, context before, edges, and a counter-context. Votes are
counted per pattern across all candidates; expectation maximisation over those
counts (at most kinds * 3**5 rows, the only thing that reaches the driver)
estimates each labeler's reliability, and its posteriors train a logistic span
classifier over votes, kind and length, which decides on the looser candidates.
The classifier is applied as a column expression.

Null is an empty text. Rows are judged one by one (repeated rows alike), by a
model that is the same for all. Without candidates the classifier adds
nothing. Extra columns are ignored by ``found`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.runtime import materialize

KINDS = ("email", "ip", "card", "phone", "name", "id", "account", "secret")
#: Spans that are walked over at a time, so that the work stays linear in their number.
CHUNK = 256
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: (kind, needed first, pattern, strict check). The repeats are possessive and the
#: starts anchored at runs, so matching is linear in the text; matches are those of
#: the plain patterns: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on.
STRICT = (
    ("email", r"@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True)),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    ("card", r"[0-9][ -]?[0-9][ -]?[0-9]", r"[0-9](?:[ -]?+[0-9]){11,}+", lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m))),
    ("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15)),
)
LOOSE = (
    ("email", r"(?i)[(\[ ]at[)\] ]", r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,40}+ ?(?:\(at\)|\[at\]) ?[a-z0-9-]{2,40}+ ?(?:\(dot\)|\[dot\]|\.) ?[a-z]{2,10}\b"),
    ("phone", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+(.-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("name", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}\p{Ll}{1,20}(?: \p{Lu}\p{Ll}{1,20})?"),
    ("id", r"[0-9]{3}-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("account", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"),
    ("secret", r"[=:] ?[\"']?[A-Za-z0-9_+/-]{16}", r"(?<=[=:] ?[\"']?)(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,200}+(?![A-Za-z0-9_+/-])"),
)
#: Words that, shortly before a span, speak for its kind.
CONTEXT = {
    "email": r"e-?mail|contact|write to|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|credit|tarjeta|carte|karte",
    "phone": r"phone|call|tel\b|tel\.|mobile|fax|tel[eé]fono|t[eé]l[eé]phone|telefon",
    "name": r"\bby\b|dear|signed|name",
    "id": r"\bssn\b|social|passport|identity",
    "account": r"iban|account|cuenta|compte|konto",
    "secret": r"(?:token|secret|passw|pwd|key|auth|credential|bearer)[a-z_]{0,12}[\"']? ?[=:] ?[\"']?$",
}
#: Known endings, ranges, issuers, calling codes, names and countries.
GAZETTEER = {
    "email": r"(?i)\.\s?(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu)$",
    "ip": r"^(?!0\.|127\.|255\.|169\.254\.)",
    "card": r"^[3-6]",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\()",
    "name": r" (?:John|Mary|James|Anna|Maria|Peter|Paul|Jean|Marie|Juan|Carlos|Hans|Karl|Laura|David|Sarah)\b",
    "id": r"^(?!000|666|9)",
    "account": r"^(?:AT|BE|CH|DE|ES|FR|GB|IE|IT|LU|NL|PT)",
    "secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA|ASIA|ghp_|gho_|glpat-|sk-|pk_|xox[abp]-|AIza|eyJ)",
}
#: A secret's form: letters and digits, neither rare.
MIXED = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){2})"
COUNTER = r"(?:version|\bv|isbn|license|licence|section|=\s*\"?|#|/)\s*$"
#: An assigned value may be a secret, but not where it is called a digest.
COUNTER_OF = {"secret": r"(?:sha[0-9]*|md5|checksum|digest|commit|uuid|version)[\"']? ?[=:] ?[\"']?$"}
VOTES = ("form", "gazetteer", "context", "edges", "counter")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


SPAN = "struct<start:int,end:int,text:string,before:string,after:string>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _walk(items: Column, state: str, start: Column, kind: str, step) -> Column:
    """What ``step(state, item) -> (state, output)`` puts out for each item in turn; ``kind`` is the outputs' type."""
    inner = f"struct<state:{state},out:array<{kind}>>"
    none = lambda t: F.from_json(F.lit("[]"), t)

    def one(acc, x):
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.array_append(acc["out"], out).alias("out")).cast(inner)

    def chunk(acc, c):
        part = F.slice(acc["items"], c * CHUNK + 1, F.lit(CHUNK))
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none(f"array<{kind}>").alias("out")).cast(inner), one)
        return _let(done, lambda d: F.struct(acc["items"].alias("items"), d["state"].alias("state"), F.array_append(acc["out"], d["out"]).alias("out")))

    def walked(v):
        begin = F.struct(v.alias("items"), start.alias("state"), none(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor(F.size(v) / CHUNK).cast("int")), begin, chunk)["out"])

    return _let(items, walked)


def _matches(text: Column, needed: str, pattern: str) -> Column:
    """All matches as SPAN: code points, end exclusive, with up to 40 characters of what is before (back to the match before) and the one after."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def step(at, x):
        start = at + F.length(x["b"])
        end = start + F.length(x["m"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"), F.right(x["b"], F.lit(40)).alias("before"), F.substring(x["after"], 1, 1).alias("after"))

    def items(g):
        n = F.size(g["found"])
        return F.arrays_zip(F.slice(g["between"], 1, n).alias("b"), g["found"].alias("m"), F.slice(g["between"], 2, n).alias("after"))

    return F.when(text.rlike(needed), _walk(_let(both, items), "int", F.lit(0), SPAN, step)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _vote(condition: Column, yes: int, no: int) -> Column:
    return F.when(condition, yes).otherwise(no).cast("int")


def _described(spans: Column, kind: str, strict: bool) -> Column:
    """Spans with their votes and length class."""

    def one(x):
        before = F.lower(x["before"])
        left = F.right(x["before"], F.lit(1))
        edge = r"^[^\p{L}\p{N}_]$"
        form = F.lit(1) if strict else _vote(x["text"].rlike(MIXED), 1, -1) if kind == "secret" else F.lit(0)
        return F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            x["end"].alias("end"),
            F.lit(strict).alias("strict"),
            form.alias("form"),
            _vote(x["text"].rlike(GAZETTEER[kind]), 1, -1).alias("gazetteer"),
            _vote(before.rlike(CONTEXT[kind]), 1, 0).alias("context"),
            _vote(((x["start"] == 0) | left.rlike(edge)) & ((x["after"] == "") | x["after"].rlike(edge)), 1, -1).alias("edges"),
            _vote(before.rlike(COUNTER_OF.get(kind, COUNTER)), -1, 0).alias("counter"),
            F.least(F.lit(5), F.floor((x["end"] - x["start"]) / 6)).cast("int").alias("length"),
        )

    return F.transform(spans, one)


def _passing(spans: Column, check) -> Column:
    return F.filter(spans, lambda x: check(x["text"]))


def candidates(text: Column) -> Column:
    """All candidates of a text, sorted by start and kind."""
    parts = []
    for kind, needed, pattern, check in STRICT:
        parts.append(_described(_passing(_matches(text, needed, pattern), check), kind, True))
    for kind, needed, pattern in LOOSE:
        parts.append(_described(_matches(text, needed, pattern), kind, False))
    return F.array_sort(F.concat(*parts))


@dataclass(frozen=True)
class Model:
    """Estimated reliabilities (labeler: chance to be right) and the classifier's weights by (feature, value)."""

    reliability: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)
    bias: float = -1.0

    def probability(self, x: Column) -> Column:
        z = F.lit(self.bias)
        for name in ("kind", "length", *VOTES):
            values = {v: w for (f, v), w in self.weights.items() if f == name}
            if values:
                chosen = F.lit(0.0)
                for v, w in sorted(values.items()):
                    chosen = F.when(x[name] == v, float(w)).otherwise(chosen)
                z = z + chosen
        return 1 / (1 + F.exp(-z))


def estimate(counts: list[tuple[dict, int]], turns: int = 30) -> tuple[dict, float, list[float]]:
    """EM over vote patterns: each labeler is right with its own chance; returns those, the prior and the posteriors."""
    right = {v: 0.8 for v in VOTES}
    prior, posteriors = 0.5, []
    for _ in range(turns):
        posteriors = []
        for row, _n in counts:
            yes, no = math.log(prior), math.log(1 - prior)
            for v in VOTES:
                if row[v]:
                    p, q = math.log(right[v]), math.log(1 - right[v])
                    yes += p if row[v] > 0 else q
                    no += q if row[v] > 0 else p
            posteriors.append(1 / (1 + math.exp(min(500, no - yes))))
        total = sum(n for _, n in counts)
        prior = min(0.95, max(0.05, sum(p * n for p, (_, n) in zip(posteriors, counts)) / total))
        for v in VOTES:
            hits = sum(n * (p if row[v] > 0 else 1 - p) for p, (row, n) in zip(posteriors, counts) if row[v])
            seen = sum(n for row, n in counts if row[v])
            right[v] = min(0.98, max(0.55, (hits + 1.6) / (seen + 2)))  # a labeler is better than chance
    return right, prior, posteriors


def train(counts: list[tuple[dict, int]], turns: int = 300, rate: float = 1.0) -> Model:
    """The span classifier: weighted logistic regression on EM's posteriors."""
    if not counts:
        return Model()
    right, _, posteriors = estimate(counts)
    weights: dict = {}
    bias, total = 0.0, sum(n for _, n in counts)
    for _ in range(turns):
        step: dict = {}
        slope = 0.0
        for p, (row, n) in zip(posteriors, counts):
            names = [(f, row[f]) for f in ("kind", "length", *VOTES)]
            z = bias + sum(weights.get(k, 0.0) for k in names)
            g = n / total * (p - 1 / (1 + math.exp(-max(-500, min(500, z)))))
            slope += g
            for k in names:
                step[k] = step.get(k, 0.0) + g
        bias += rate * slope
        for k, g in step.items():
            weights[k] = weights.get(k, 0.0) + rate * (g - 0.001 * weights.get(k, 0.0))
    return Model(right, weights, bias)


def fit(spans: DataFrame) -> Model:
    """From rows with a column ``candidates``; what is collected has at most kinds * 6 * 2 * 3**5 rows."""
    names = ["kind", "length", *VOTES]
    rows = spans.select(F.explode("candidates").alias("x")).groupBy(*[F.col(f"x.{n}").alias(n) for n in names]).count().collect()
    counts = sorted((tuple(r[n] for n in names), r["count"]) for r in rows)
    return train([(dict(zip(names, k)), n) for k, n in counts])


#: A span that is kept, and one on the way there.
_KEPT = "struct<start:int,kind:int,end:int,strict:boolean>"
_FREE = "struct<start:int,kind:int,end:int,strict:boolean,free:boolean>"


def _kept(found: Column, model: Model) -> Column:
    """Strict spans, and likely looser ones that overlap no strict one and no likely one before them.

    ``found`` is sorted by start. Three sweeps: one has the last end of strict spans before, one (backwards) the first
    start of those behind, one the last end of the looser ones that are left, so the work is linear in a text's spans.
    """

    def sweep(spans, first, after, free):
        def step(at, x):
            ok = x["free"] & (x["strict"] | free(at, x))
            return after(at, x, ok), F.struct(*[x[n].alias(n) for n in ("start", "kind", "end", "strict")], ok.alias("free"))

        return _walk(spans, "int", F.lit(first), _FREE, step)

    def judged(x):
        likely = x["strict"] | (model.probability(x) >= 0.5)
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["strict"].alias("strict"), likely.alias("free"))

    likely = F.filter(F.transform(found, judged), lambda x: x["free"])
    strict_end = lambda at, x, ok: F.when(x["strict"], F.greatest(at, x["end"])).otherwise(at)
    strict_start = lambda at, x, ok: F.when(x["strict"], x["start"]).otherwise(at)
    loose_end = lambda at, x, ok: F.when(ok & ~x["strict"], F.greatest(at, x["end"])).otherwise(at)
    before = sweep(likely, 0, strict_end, lambda at, x: at <= x["start"])
    behind = sweep(F.reverse(before), 2**31 - 1, strict_start, lambda at, x: at >= x["end"])
    free = F.filter(F.reverse(behind), lambda x: x["free"])
    # a looser span stands behind the ends of all free ones before it, whether those were kept or not
    seen = _walk(free, "int", F.lit(0), _FREE, lambda at, x: (loose_end(at, x, F.lit(True)), F.struct(*[x[n].alias(n) for n in ("start", "kind", "end", "strict")], (x["strict"] | (at <= x["start"])).alias("free"))))
    return F.transform(F.filter(seen, lambda x: x["free"]), lambda x: F.struct(*[x[n].alias(n) for n in ("start", "kind", "end", "strict")]).cast(_KEPT))


def _named(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def text_of() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def found(documents: DataFrame) -> DataFrame:
    """doc_id, candidates, spans (those kept) of every whole text."""
    rows = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(text_of()).alias("candidates")), "pii")
    return rows.withColumn("spans", _kept(F.col("candidates"), fit(rows)))


def redact(documents: DataFrame) -> DataFrame:
    """The same columns; each span in the text gives way to its kind in brackets, and n_chars follows."""
    model = fit(documents.select(candidates(text_of()).alias("candidates")))
    row = F.struct(*[documents[f"`{c}`"].alias(c) for c in documents.columns])
    rows = documents.select(row.alias("row"), F.col("text"), candidates(text_of()).alias("candidates"))
    rows = rows.select("row", "text", _let(F.col("candidates"), lambda c: _kept(c, model)).alias("spans"))
    text, spans, whole = F.col("text"), F.col("spans"), "struct<at:int,out:array<string>>"
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)

    def chunk(acc, c):  # the text of so many spans is cut out once, and they are cut out of it
        part = F.slice(spans, c * CHUNK + 1, F.lit(CHUNK))
        last = F.greatest(acc["at"], F.coalesce(F.array_max(F.transform(part, lambda x: x["end"])), F.lit(0)))
        some = F.struct(acc.alias("acc"), part.alias("part"), last.alias("last"), F.substring(text, acc["at"] + 1, last - acc["at"]).alias("text"))

        def cut(g):
            def one(a, x):
                gap = F.substring(g["text"], a["at"] - g["acc"]["at"] + 1, F.greatest(F.lit(0), x["start"] - a["at"]))
                mark = F.when(x["start"] >= a["at"], F.concat(F.lit("["), F.upper(kind(x)), F.lit("]"))).otherwise(F.lit(""))
                return F.struct(F.greatest(x["end"], a["at"]).alias("at"), F.array_append(a["out"], F.concat(gap, mark)).alias("out")).cast(whole)

            done = F.aggregate(g["part"], F.struct(g["acc"]["at"].alias("at"), F.from_json(F.lit("[]"), "array<string>").alias("out")).cast(whole), one)
            return F.struct(g["last"].alias("at"), F.array_append(g["acc"]["out"], F.array_join(done["out"], "")).alias("out")).cast(whole)

        return _let(some, cut).cast(whole)

    walked = F.aggregate(F.sequence(F.lit(0), F.floor(F.size(spans) / CHUNK).cast("int")), F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<string>").alias("out")).cast(whole), chunk)
    rows = rows.select("row", "text", "spans", walked.alias("walked"))
    clean = F.when(F.size("spans") == 0, text).otherwise(F.concat(F.array_join("walked.out", ""), F.substring(text, F.col("walked.at") + 1, F.length(text))))
    rows = rows.select("row", clean.alias("text"))
    out = {c: F.col("row").getField(c) for c in documents.columns} | {"text": F.col("text")}
    if "n_chars" in documents.columns:
        out["n_chars"] = F.when(F.col("text").isNull(), out["n_chars"]).otherwise(F.length("text").cast(documents.schema["n_chars"].dataType))
    return rows.select(*[out[c].alias(c) for c in documents.columns])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    rows = found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("candidates", lambda x: x["strict"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select("doc_id", *counts, F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def brute_force(rows) -> dict:
    """{doc_id: (n_email, n_ip, n_card, n_phone, base_sha256)} by the plain patterns."""
    import hashlib
    import re

    def luhn(d):
        s = [int(c) for c in reversed(d)]
        return sum(s[0::2]) + sum(sum(divmod(2 * c, 10)) for c in s[1::2])

    digits = lambda m: re.sub("[^0-9]", "", m)
    plain = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)) % 10 == 0),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    out = {}
    for d, t in rows:
        spans = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(plain) for m in re.finditer(p, t or "") if ok(m[0])]
        named = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        out[d] = (*(sum(k == j for _, k, _ in spans) for j in range(4)), hashlib.sha256(named.encode()).hexdigest())
    return out
