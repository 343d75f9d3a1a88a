"""Personal data by candidates and gradient boosting, in DataFrame functions only.

Generators propose spans of four kinds: the formats that always count if their digits hold up (the
base), and wider ones that overlap them. Those that fail the kind's test (octets, Luhn, number of
digits) are no candidates; the others get format and context features. Candidates in a base format
are examples. Loose ones (blanks around a bare @ or dot, no plus, other separators) read like prose,
numbering or order numbers as well: they are examples right after a cue word and counter-examples
otherwise; parts that count up (1. 2. 3. 4) and sentences that end after an @ are no candidates. Candidates are counted by feature vector over the whole corpus and a few fixed texts
(KNOWN), and trees are boosted on the counts. A probability fitted on held-back texts and a threshold
per kind (precision on those texts) decide which wide candidates are added. Base spans always stay.

The patterns match what their plain forms match (see the README's table), but never try a start
within a run again, so that long runs of digits or letters take linear time.

Rows
    null and empty texts have no span. Repeated rows are read each. Positions count code points from
    0, ends are exclusive. Added spans do not overlap a base span of their kind.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm import boosting
from corpus_search.llm.tables import whole

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++|\x20?\.\x20?[a-z]{2,8}+(?![A-Za-z0-9-]))++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]{0,2}+(?:\x20?\.\x20?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"[0-9](?<![0-9][0-9])(?:[0-9]{12,18}+|[0-9]{3}(?:[\x20./_-]{1,2}[0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without the sign (or one of the digits) has no candidate of the kind.
SIGN = {"email": "@|[(\\[]at[)\\]]", "ip": "[0-9]\\x20?\\.\\x20?[0-9]", "card": "[0-9]{4}|[0-9][\\x20-][0-9]", "phone": "\\+[0-9]|[0-9]{3}[\\x20.-][0-9]{4}"}
#: Words that often stand before a span.
CUES = {
    "email": "e?-?mails?|contact|write",
    "ip": "ips?|host|server|address",
    "card": "cards?|visa|pay|paid",
    "phone": "tel|telephone|phone|call|fax|mobile|mobil|reach",
}
#: Fixed value: words that may stand between a cue and its span.
BETWEEN = "me|us|him|her|them|on|at|is|to|by|via|under|with|number|no|nr|my|our|the"
#: What tells a span that is not in a base format.
LOOSE = {"email": r"^(?!.*[(\[]at[)\]].*[(\[]dot[)\]]).*[\x20(\[]", "ip": r"\x20", "card": r"[./_]|[\x20-]{2}", "phone": r"^[^+]"}
#: Texts to learn from besides the corpus, so often each, that a rare form does not go unjudged.
KNOWN = (
    "look @ home. Then", "we met @ noon. After", "1. 2. 3. 4", "see 2 . 1 . 4 . 3", "order 123-456-7890", "no 555 123 4567",
    "4111.1111.1111.1111", "mail ann @ site. org", "contact: ann@site .org", "server 10. 0. 0. 7", "host 10 . 0 . 0 . 7",
    "call 123-456-7890", "phone (555) 123-4567", "card 4111.1111.1111.1111", "visa 4111/1111/1111/1111",
)
TIMES = 20
GAP = r"[^\p{L}\p{N}]{0,4}"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PRECISION = 0.99
BLOCK = 512
FEATURES = ("kind", "digits", "length", "loose", "separators", "before", "after", "cue", "plus")


def starts(gaps: Column, lengths: Column) -> Column:
    """Where each match begins: the sum of the gaps up to it and of the matches before it. Sums are
    made by blocks, so that a text with very many matches stays linear."""
    steps = F.zip_with(lengths, gaps, lambda n, g: F.struct(g.cast("long").alias("g"), n.cast("long").alias("n")))
    empty = F.array().cast("array<bigint>")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(steps, b * BLOCK + 1, BLOCK),
    )

    def within(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
            lambda a, s: F.struct(
                (a["at"] + s["g"] + s["n"]).alias("at"),
                F.concat(a["out"], F.array(a["at"] + s["g"])).alias("out"),
            ),
        )

    return F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out")),
        lambda a, block: F.transform(
            F.array(within(block)),
            lambda w: F.struct(
                (a["at"] + w["at"]).alias("at"),
                F.concat(a["out"], F.array(F.transform(w["out"], lambda x: x + a["at"]))).alias("out"),
            ),
        )[0],
        lambda a: F.flatten(a["out"]),
    )


def located(matches: Column, text: Column, pattern: str) -> Column:
    """Matches with their place: array of (s, e, x)."""
    kind = "array<struct<s:bigint,e:bigint,x:string>>"
    n = F.size(matches)
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), 1, n)
    places = F.zip_with(
        starts(gaps, F.transform(matches, F.char_length)),
        matches,
        lambda s, x: F.struct(s.alias("s"), (s + F.char_length(x)).alias("e"), x.alias("x")),
    )
    return F.when(n > 0, places).otherwise(F.array()).cast(kind)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.char_length(d)

    def term(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + term(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _counts_up(octets: Column) -> Column:
    """Whether the parts go up by one, as numbering does."""
    parts = F.transform(F.split(octets, r"\."), lambda p: F.try_to_number(p, F.lit("99999999")).cast("int"))
    return F.coalesce((parts[1] - parts[0] == 1) & (parts[2] - parts[1] == 1) & (parts[3] - parts[2] == 1), F.lit(False))


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        octets = F.regexp_replace(x, "\\x20", "")
        return octets.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$") & ~(F.contains(x, F.lit(" ")) & _counts_up(octets))
    if kind == "card":
        return luhn(digits(x))
    if kind == "phone":
        return F.char_length(digits(x)).between(9, 15)
    return x.isNotNull()


def _class(c: Column) -> Column:
    return (
        F.when((c == "") | c.rlike("^\\s$"), 0)
        .when(c.rlike("^\\p{L}$"), 1)
        .when(c.rlike("^[0-9]$"), 2)
        .otherwise(3)
    )


def features(kind: str, span: Column, text: Column) -> Column:
    x, s, e = span["x"], span["s"], span["e"]
    low = F.greatest(s - 24, F.lit(0))
    near = F.lower(F.substring(text, (low + 1).cast("int"), (s - low).cast("int")))
    kinds = [F.when(x.contains(c), 1).otherwise(0) for c in (" ", "-", ".", "(")]
    before = F.when(s > 0, F.substring(text, s.cast("int"), F.lit(1))).otherwise("")
    values = (
        F.lit(KINDS.index(kind)),
        F.least(F.char_length(digits(x)), F.lit(20)),
        F.least(F.floor(F.char_length(x) / 4), F.lit(15)).cast("int"),
        x.rlike(LOOSE[kind]).cast("int"),
        sum(kinds[1:], kinds[0]),
        _class(before),
        _class(F.substring(text, (e + 1).cast("int"), F.lit(1))),
        near.rlike(rf"\b(?:{CUES[kind]})\b{GAP}(?:(?:{BETWEEN})\b{GAP}){{0,3}}$").cast("int"),
        x.contains("+").cast("int"),
    )
    return F.struct(*(v.alias(f) for f, v in zip(FEATURES, values, strict=True)))


def candidates(df: DataFrame, text_col: str = "_text") -> DataFrame:
    """Adds, per kind, the base matches (`b_`), the valid ones (`v_`) and the valid wide ones that do
    not overlap one of these (`w_`)."""
    text = F.col(text_col)
    for prefix, patterns in (("b", BASE), ("w", WIDE)):
        df = df.withColumns(
            {
                f"m{prefix}_{k}": F.when(text.rlike(SIGN[k]), F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0)))
                .otherwise(F.array().cast("array<string>"))
                for k in KINDS
            }
        )
    df = df.withColumns(
        {f"{p}_{k}": located(F.col(f"m{p}_{k}"), text, d[k]) for p, d in (("b", BASE), ("w", WIDE)) for k in KINDS}
    ).drop(*(f"m{p}_{k}" for p in "bw" for k in KINDS))
    df = df.withColumns({f"v_{k}": F.filter(f"b_{k}", lambda b: valid(k, b["x"])) for k in KINDS})
    apart = {
        f"w_{k}": F.filter(
            f"w_{k}",
            lambda w: ~F.exists(f"v_{k}", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])) & valid(k, w["x"]),
        )
        for k in KINDS
    }
    return df.withColumns(apart)


@dataclass
class Model:
    trees: list = field(default_factory=list)
    slope: float = 1.0
    constant: float = 0.0
    thresholds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(KINDS, 2.0))

    def probability(self, values: list[Column]) -> Column:
        m = sum((t.column(values) for t in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-(m * self.slope + self.constant)))


def fit(df: DataFrame) -> Model:
    """The model for the candidates of all rows of `df` (which has `_text`).

    What comes to the driver is a count per feature vector; features have at most 21 values, so the
    number of vectors has a bound that does not depend on the corpus.
    """
    text = F.col("_text")
    spark = df.sparkSession
    known = spark.range(2 * TIMES).select(
        F.explode(F.array(*map(F.lit, KNOWN))).alias("_text"), (F.col("id") % 2 == 0).alias("back")
    )
    rows = df.select("_text", (F.crc32(text.cast("binary")) % 5 == 0).alias("back")).unionAll(known)
    found = candidates(rows)

    def examples(k: str) -> Column:
        def labelled(c: Column) -> Column:
            f = features(k, c, text)
            return F.struct(f.alias("f"), F.when((f["loose"] == 0) | (f["cue"] == 1), 1).otherwise(0).alias("y"))

        base = F.transform(f"v_{k}", lambda b: F.struct(features(k, b, text).alias("f"), F.lit(1).alias("y")))
        # A strict form that only stands next to other digits is not told from a base one by its form.
        return F.concat(base, F.filter(F.transform(f"w_{k}", labelled), lambda c: c["f"]["loose"] == 1))

    rows = found.select("back", F.explode(F.concat(*map(examples, KINDS))).alias("c"))
    counts = rows.groupBy("back", *(F.col(f"c.f.{f}") for f in FEATURES)).agg(
        F.sum("c.y").alias("yes"), F.sum(1 - F.col("c.y")).alias("no")
    )
    table = np.array([[float(v or 0) for v in r] for r in counts.collect()]).reshape(-1, len(FEATURES) + 3)
    back, x = table[:, 0] == 1, table[:, 1:-2].astype(int)
    yes, no = table[:, -2], table[:, -1]
    if not yes[~back].sum() or not no[~back].sum():
        return Model()
    model = Model(boosting.boost(x[~back], yes[~back], no[~back]))
    m = boosting.margin(model.trees, x[back])
    model.slope, model.constant = boosting.calibrated(m, yes[back], no[back])
    p = 1 / (1 + np.exp(-(m * model.slope + model.constant)))
    for i, k in enumerate(KINDS):
        on = x[back][:, 0] == i
        model.thresholds[k] = boosting.least_probability(p[on], yes[back][on], no[back][on], PRECISION)
    return model


def spans(df: DataFrame, model: Model) -> DataFrame:
    """Adds, per kind, `v_` (base spans) and `a_` (base and added spans in order)."""
    text = F.col("_text")
    out = candidates(df)

    def kept(k: str) -> Column:
        def score(w: Column) -> Column:
            f = features(k, w, text)
            # One evaluation of the features per candidate.
            return F.transform(F.array(f), lambda v: model.probability([v[n] for n in FEATURES]))[0]

        if model.thresholds[k] > 1:
            return F.col(f"v_{k}")
        both = F.concat(f"v_{k}", F.filter(f"w_{k}", lambda w: score(w) >= model.thresholds[k] - 1e-9))
        return F.sort_array(both)

    return out.withColumns({f"a_{k}": kept(k) for k in KINDS}).drop(*(f"{p}_{k}" for p in "bw" for k in KINDS))


def listed(prefix: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    each = [
        F.transform(f"{prefix}_{k}", lambda s: F.concat_ws(":", F.lit(k), s["s"].cast("string"), s["e"].cast("string")))
        for k in KINDS
    ]
    return F.array_join(F.concat(*each), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, the number of base spans of each kind, the digest of the base spans, and
    all spans."""
    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    out = spans(rows, fit(rows))
    return out.select(
        F.col("_id").alias(id_col),
        *(F.size(f"v_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(listed("v").cast("binary"), 256).alias("base_sha256"),
        listed("a").alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; spans that overlap by the first's."""
    columns = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    mine = f"c{columns.index(text_col)}"
    rows = rows.withColumn("_text", whole(mine))
    out = spans(rows, fit(rows.select("_text")))
    every = F.sort_array(
        F.concat(
            *(
                F.transform(f"a_{k}", lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), F.lit(f"[{k.upper()}]").alias("x")))
                for k in KINDS
            )
        )
    )
    text = F.col("_text")
    pieces = F.aggregate(
        every,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(s["s"] < a["at"], F.struct(F.greatest(a["at"], s["e"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(
                s["e"].alias("at"),
                F.concat(
                    a["out"],
                    F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["s"] - a["at"]).cast("int")), s["x"]),
                ).alias("out"),
            )
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))),
    )
    out = out.withColumn("_new", F.when(F.size(every) > 0, pieces).otherwise(F.col(mine)))
    return out.select(*(F.col("_new" if f"c{i}" == mine else f"c{i}").alias(c) for i, c in enumerate(columns)))
