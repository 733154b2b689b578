"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates, over the whole text: private key blocks; quoted and unquoted values after ``=`` or ``:`` of any name, of
four characters or more and any characters; passwords in addresses; and runs of base 64, hexadecimal and their marks
of 16 characters or more with a letter and a digit, or of 24 or more with a letter.  None has an upper limit.  (A
shorter string that nothing assigns is a word like any other and no candidate.)

For each candidate features are computed from it and its line: its length; how its characters follow one another
(changes between letters, digits, cases and marks, and how usual the letters' transitions are in the words of a
dictionary); how much of it words of that dictionary cover; whether it looks like a path, an address or a
placeholder; and the words next to it, each by the log odds that it stands next to a secret among the labelled
findings.  A random forest trained on the findings gives the probability that a candidate is a secret.

Labelled findings are any table (before, candidate, after, label).  `labelled_findings` makes one by rule, of a given
size, with names that stand before secrets and others alike.  The dictionary is any list of words
(`dictionary_at` reads a public tokenizer's whole words).

Everything is DataFrame expressions and Spark's own forest; no Python runs on the rows.  Nulls: a null text has
no candidates and stays null.  Candidates that repeat in a text are told apart by their place; equal rows have
equal candidates.  An empty table has none.  Without labelled findings, or with findings of one label only, the
score is their share of label 1, or 0.  Extra columns stay untouched, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import boxed, cut, let, unboxed
from scorelake.llm.lexicon import Lexicon, once

NEAR = 48
RUN = r"[A-Za-z0-9+/_.\-]"
#: Patterns of candidates, tried in this order at each place; NEAR characters of the line on both sides are its surroundings.
PATTERNS = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[^-]+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----",
    r"""(?<=[=:][ \t]{0,3}["'`])[^"'`\n]{4,}(?=["'`])""",
    r"(?<=://[^\s/:@]{1,64}:)[^\s/@]{4,}(?=@)",
    r"""(?<=[A-Za-z0-9_\])"'][ \t]{0,3}[=:]=?[ \t]{0,3})(?!//)(?![=:])[^\s"'`,;<>(){}\[\]|]{3,}[^\s"'`,;<>(){}\[\]|.:]""",
    rf"(?<!{RUN})(?:(?={RUN}*[0-9])(?={RUN}*[A-Za-z]){RUN}{{16,}}|(?={RUN}*[A-Za-z]){RUN}{{24,}})={{0,2}}(?![A-Za-z0-9+/_=.\-])",
)
FOUND = "|".join(PATTERNS)
#: Words of at least so many letters count as covered by the dictionary; so many words and odds are kept at most.
LEAST_LETTERS, MOST_WORDS, MOST_ODDS = 4, 100_000, 2000
NOTHING = "example|xxxx|your|changeme|1234567|abcdef|placeholder|sample|dummy|redacted|[*]{4}|[$][{]|process[.]env|getenv|environ|<[a-z_]+>"

FEATURES = (
    "length", "changes", "repeats", "distinct", "digits", "uppers", "vowels", "hexadecimal", "marks", "symbols", "spaces", "transitions", "pairs", "words", "longest_word",
    "dots", "slashes", "dashes", "rooted", "extension", "address", "call", "assigned", "quoted", "block", "placeholder", "mean_step", "name_odds", "near_odds",
)


def dictionary_at(path: str, most: int = 12_000) -> list[str]:
    """The first whole words, which are the more common ones, in a word-level vocabulary file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    whole = [t.removesuffix("</w>") for t, _ in sorted(vocab.items(), key=lambda x: x[1]) if t.endswith("</w>")]
    return sorted([w for w in whole if re.fullmatch(f"[a-z]{{{LEAST_LETTERS},}}", w)][:most])


def chain(words: list[str]) -> list[float]:
    """Log probabilities of a letter after a letter over the words, 26 by 26."""
    seen = Counter(a + b for w in words for a, b in zip(w, w[1:], strict=False))
    letters = "abcdefghijklmnopqrstuvwxyz"
    after = {a: sum(seen[a + b] for b in letters) for a in letters}
    return [round(math.log((seen[a + b] + 0.5) / (after[a] + 13)), 4) for a in letters for b in letters]


@dataclass
class Scanner:
    """What a scan knows: the dictionary, its chain, the odds of neighbouring words, and the forest or a fixed score."""

    words: Lexicon
    transitions: list[float]
    odds: dict[str, float]
    forest: PipelineModel | None = None
    share: float = 0.0

    def features(self, rows: DataFrame) -> DataFrame:
        """``rows`` (candidate, before, after, ...) with the features."""
        table = "cast(split('" + ",".join(map(str, self.transitions)) + "', ',') as array<double>)"
        letters = "transform(split(lower(candidate), ''), s -> ascii(s) - 97)"
        known = "filter(transform(sequence(1, greatest(size(a) - 1, 1)), i -> case when a[i - 1] between 0 and 25 and get(a, i) between 0 and 25 then get(t, 26 * a[i - 1] + get(a, i)) end), p -> p is not null)"
        pairs = once(letters, "a", once(table, "t", known))
        covered = once(self.words.table(), "cells", f"filter(transform(regexp_extract_all(candidate, '([A-Z]?[a-z]+|[A-Z]+)', 1), w -> lower(w)), w -> length(w) >= {LEAST_LETTERS} and {self.words.has('cells', 'w')})")
        odds = "str_to_map('" + ",".join(f"{w}:{v:.3f}" for w, v in sorted(self.odds.items()) or [("-", 0.0)]) + "')"
        said = lambda side: f"filter(split(lower({side}), '[^a-z0-9_]+'), w -> w <> '')"
        names = f"concat(slice(array_append(reverse({said('before')}), ''), 1, 4), slice({said('after')}, 1, 2))"
        of = once(odds, "o", f"transform({names}, w -> coalesce(cast(element_at(o, w) as double), 0D))")
        # Once for each row, as the tables in them are large.
        made = rows.select("*", F.explode(F.array(F.struct(F.expr(pairs).alias("pairs"), F.expr(f"transform({covered}, w -> length(w))").alias("words"), F.expr(of).alias("odds")))).alias("_f"))
        return made.select("*", *self._features()).drop("_f")

    @staticmethod
    def _features() -> list[Column]:
        share = lambda c, pattern: F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))
        x, left, right = F.col("candidate"), F.col("before"), F.col("after")
        low = F.lower(x)
        kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "m")
        codes = F.transform(F.split(x, ""), lambda s: F.ascii(s))
        step = let(codes, lambda a: F.aggregate(F.zip_with(F.slice(a, 2, F.size(a)), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda p, q: F.abs(p - q)), F.lit(0).cast("long"), lambda s, p: s + p) / F.greatest(F.size(a) - 1, F.lit(1)))
        values = {
            "length": F.length(x),
            "changes": F.regexp_count(kind, F.lit("(?<=l)[udm]|(?<=u)[ldm]|(?<=d)[lum]|(?<=m)[lud]")) / F.greatest(F.length(x), F.lit(1)),
            "repeats": F.regexp_count(low, F.lit(r"(.)(?=\1)")) / F.greatest(F.length(x), F.lit(1)),
            "distinct": F.size(F.array_distinct(F.split(low, ""))) / F.greatest(F.least(F.length(x), F.lit(36)), F.lit(1)),
            "digits": share(x, "[0-9]"),
            "uppers": share(x, "[A-Z]"),
            "vowels": share(low, "[aeiou]"),
            "hexadecimal": share(low, "[0-9a-f]"),
            "marks": share(x, r"[+/_=.\-]"),
            "symbols": share(x, r"[^A-Za-z0-9+/_=.\-\s]"),
            "spaces": F.regexp_count(x, F.lit(r"\s")),
            "transitions": F.expr("case when size(_f.pairs) = 0 then -9D else aggregate(_f.pairs, 0D, (s, v) -> s + v) / size(_f.pairs) end"),
            "pairs": F.size("_f.pairs") / F.greatest(F.length(x), F.lit(1)),
            "words": F.expr("aggregate(_f.words, 0, (s, n) -> s + n)") / F.greatest(F.length(x), F.lit(1)),
            "longest_word": F.coalesce(F.array_max("_f.words"), F.lit(0)),
            "dots": F.regexp_count(x, F.lit(r"\.")),
            "slashes": F.regexp_count(x, F.lit("/")),
            "dashes": F.regexp_count(x, F.lit("-")),
            "rooted": x.rlike(r"^(\.{0,2}/|~/|[A-Za-z]:\\|[a-z]+://)"),
            "extension": F.concat(x, F.substring(right, F.lit(1), F.lit(6))).rlike(r"\.(com|org|net|io|html?|png|jpe?g|js|css|py|txt|json|ya?ml|md|xml|csv|log)\b"),
            "address": x.contains("@") | left.endswith("@") | right.startswith("@"),
            "call": right.startswith("(") | x.rlike(r"^[A-Za-z_.]+\("),
            "assigned": left.rlike(r"""[=:]\s*["'`]?$"""),
            "quoted": left.rlike("""["'`]$""") & right.rlike("""^["'`]"""),
            "block": x.startswith("-----BEGIN"),
            "placeholder": low.rlike(NOTHING),
            "mean_step": step,
            "name_odds": F.expr("coalesce(get(_f.odds, 0), 0D)"),
            "near_odds": F.expr("aggregate(_f.odds, 0D, (s, v) -> s + v)"),
        }
        return [values[f].cast("double").alias(f) for f in FEATURES]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, place, before, candidate, after): every candidate of every text; the place is its number in the text."""
    found = docs.where(F.col("text").rlike("[0-9=:]|-----BEGIN|[A-Za-z+/_.-]{24}"))
    marked = pieces(F.col("text"))
    near = lambda p, i: F.struct(
        F.floor(i / 2).cast("int").alias("place"),
        F.element_at(F.split(F.substring(F.get(p, i - 1), -NEAR, NEAR), "\n", -1), -1).alias("before"),
        F.get(p, i).alias("candidate"),
        F.element_at(F.split(F.substring(F.get(p, i + 1), 1, NEAR), "\n", -1), 1).alias("after"),
    )
    listed = let(marked, lambda p: F.filter(F.transform(p, lambda x, i: F.when(i % 2 == 1, near(p, i))), lambda x: x.isNotNull()))
    return found.select("doc_id", F.xxhash64("text").alias("_th"), F.explode(listed).alias("c")).select("doc_id", "_th", "c.*")


def pieces(text: Column) -> Column:
    """The text cut at its candidates, which are every second piece; the character \u0001 counts as a space."""
    plain = F.regexp_replace(text, "\u0001", " ")
    return F.split(F.regexp_replace(plain, "(" + FOUND + ")", "\u0001$1\u0001"), "\u0001", -1)


#: Names before values, of secrets and of other things.
SECRET_NAMES = "password passwd pwd pass secret token api_key apikey access_key auth bearer credential client_secret private_key session_key db_password".split()
OTHER_NAMES = "value data cfg config name id url path file version user host title description default label type status date time size note key".split()
DIGEST_NAMES = "sha1 sha256 sha512 md5 checksum commit digest hash etag integrity revision blob fingerprint build".split()


def labelled_findings(spark: SparkSession, words: list[str], rows: int = 8000, seed: int = 5) -> DataFrame:
    """A bounded table of labelled findings made by rule, the same on every run; ``words`` are for prose and identifiers."""
    words = words[:: max(1, len(words) // 250)][:250] or ["word"]
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    r = lambda salt, n: f"pmod(xxhash64(id, '{salt}', {seed}), {n})"
    pick = lambda salt, of: f"element_at(array({', '.join(map(quote, of))}), cast({r(salt, len(of))} as int) + 1)"
    word = lambda salt: f"element_at(split('{','.join(words)}', ','), cast({r(salt, len(words))} as int) + 1)"
    text = lambda salt, n: f"concat_ws(' ', {', '.join(word(f'{salt}{k}') for k in range(n))})"
    size = lambda salt, lo, hi: f"cast({lo} + {r(salt, hi - lo + 1)} as int)"
    digest = lambda salt: f"sha2(concat_ws(':', id, '{salt}', {seed}), 512)"
    hexa = lambda salt, n: f"substring({digest(salt)}, 1, {n})"
    b64 = lambda salt: f"concat({', '.join(f'base64(unhex({digest(salt + str(k))}))' for k in range(4))})"
    mixed = lambda salt, n: f"substring(translate({b64(salt)}, '+/=', 'AbC'), 1, {n})"
    odd = lambda salt, n: f"substring(translate({b64(salt)}, 'aeiostADGKQ+/=', '!@#$%^&*?-_.~%'), 1, {n})"
    hexes = f"element_at(array(32, 40, 64, 128), cast({r('hx', 4)} as int) + 1)"
    any_name, digests = SECRET_NAMES + OTHER_NAMES, DIGEST_NAMES
    mostly = SECRET_NAMES * 3 + OTHER_NAMES
    assigned = [' = "', ": ", '="', "=", ": '", '": "', " := "]
    bare = [" ", " is ", " at ", " - "]
    #: label, names, what stands between name and value, value
    cases = [
        (1, mostly, assigned, mixed("a", size("al", 16, 64))),
        (1, mostly, assigned, hexa("b", hexes)),
        (1, mostly, assigned, f"concat({pick('c', ['ghp_', 'sk_live_', 'xoxb-', 'glpat-', 'AKIA', 'key-'])}, {mixed('cm', size('cl', 16, 40))})"),
        (1, mostly, assigned, f"concat(substring({b64('d')}, 1, {size('dl', 40, 120)}), '==')"),
        (1, mostly, assigned, odd("e", size("el", 8, 24))),
        (1, mostly, assigned, f"concat(initcap({word('f')}), {pick('fs', list('!$%&*+-_#'))}, initcap({word('f2')}), {r('fn', 1000)}, {pick('ft', list('!$%&*+?#'))})"),
        (1, mostly, assigned, f"concat({word('f4')}, {pick('f5', list('!$%&*+-_#'))}, initcap({word('f6')}), {r('f7', 10)}, {pick('f8', list('!$%&*+?#'))}, {word('f9')})"),
        (1, SECRET_NAMES, assigned, f"concat({word('g')}, {r('gn', 100)}, {mixed('gm', size('gl', 2, 6))})"),
        (1, mostly, assigned, f"concat('eyJ', {mixed('h', 40)}, '.', {mixed('h2', size('hl', 60, 340))}, '.', {mixed('h3', 43)})"),
        (1, any_name, [":\n", " = ", " "], f"concat('-----BEGIN ', {pick('i', ['', 'RSA ', 'EC ', 'OPENSSH '])}, 'PRIVATE KEY-----\\n', {b64('ib')}, '\\n-----END PRIVATE KEY-----')"),
        (1, OTHER_NAMES, [" postgres://admin:", " https://user:"], mixed("j", size("jl", 8, 24))),
        (1, SECRET_NAMES, bare, mixed("k", size("kl", 20, 48))),
        (1, SECRET_NAMES, bare, hexa("k2", hexes)),
        (0, digests * 3 + OTHER_NAMES, assigned + bare * 2, hexa("l", hexes)),
        (0, digests + OTHER_NAMES, assigned + bare, hexa("l2", f"least({hexes}, 40)")),
        (0, any_name, assigned + bare, f"concat_ws('-', {hexa('m', 8)}, {hexa('m1', 4)}, {hexa('m2', 4)}, {hexa('m3', 4)}, {hexa('m4', 12)})"),
        (0, any_name, assigned + bare, f"concat({pick('n', ['/', './', '//', '~/', ''])}, {word('n1')}, '/', {word('n2')}, '/', {word('n3')}, {r('nn', 99)}, {pick('ne', ['.html', '.py', '/v2', '.json', ''])})"),
        (0, any_name, assigned, word("o")),
        (0, any_name, assigned, f"concat({word('p')}, {pick('ps', ['_', '-', '.'])}, {word('p2')})"),
        (0, any_name, bare, f"concat({word('p3')}, initcap({word('p4')}), initcap({word('p5')}), {r('pn', 9)})"),
        (0, any_name, assigned[:1], text("q", 4)),
        (0, any_name, assigned[:1] + assigned[2:3], f"concat(initcap({word('q5')}), ' ', {text('q6', 3)})"),
        (0, any_name, assigned, f"concat({r('s', 30)}, '.', {r('s2', 30)}, '.', {r('s3', 999)})"),
        (0, any_name, assigned, f"concat('20', 10 + {r('t', 20)}, '-0', 1 + {r('t2', 9)}, '-1', {r('t3', 9)}, 'T10:', 10 + {r('t4', 49)})"),
        (0, any_name, bare + assigned, f"concat({word('u')}, '.', {word('u2')}, {r('un', 99)}, '@', {word('u3')}, {r('um', 9)}, '.example.com')"),
        (0, any_name, bare, f"concat({word('u4')}, {r('uo', 99)}, '-', {word('u5')}, {r('up', 9)}, '.example.', {pick('uq', ['com', 'org', 'net'])})"),
        (0, SECRET_NAMES, assigned, pick("v", ["changeme", "your_password_here", "xxxxxxxxxxxx", "********", "<password>", "example", "placeholder", "dummy_secret_1234567", "none", "null", "true", "required", "string"])),
        (0, SECRET_NAMES, assigned, f"concat({pick('w', ['${', 'process.env.', 'os.environ.', 'config.', 'self.', 'get_'])}, {word('w1')}, {pick('w2', ['_key}', '_token', '.secret', '_password()'])})"),
        (0, any_name, assigned, f"cast(1000 + {r('x', 10**9)} as string)"),
        (0, any_name, bare, f"concat({word('y')}, '-', {word('y2')}, '-', {word('y3')}, '-', {word('y4')})"),
    ]
    close = "case " + " ".join(f"when endswith(between, {quote(q)}) then {quote(q)}" for q in ('"', "'")) + " when contains(between, '://') then '@' else ' ' end"
    # One small plan for each case: all in one expression would be too much code for the compiler.
    ids = spark.range(0, rows, 1, 1).withColumn("choice", F.expr(r("case", len(cases))))
    made = [ids.where(F.col("choice") == i).selectExpr("id", f"{pick(f'1{i}', names)} as name", f"{pick(f'2{i}', between)} as between", f"{value} as candidate", f"{label} as label") for i, (label, names, between, value) in enumerate(cases)]
    made = [m.selectExpr(f"concat({text('z', 2)}, ' ', name, between) as before", "candidate", f"concat({close}, {text('zz', 2)}) as after", "label") for m in made]
    return reduce(DataFrame.unionByName, made)


def neighbour_odds(findings: DataFrame, least: int = 5) -> dict[str, float]:
    """For words next to findings, up to ``MOST_ODDS`` of them, the log odds that the finding is a secret, against all findings'."""
    said = F.expr("concat(slice(reverse(filter(split(lower(before), '[^a-z0-9_]+'), w -> w <> '')), 1, 4), slice(filter(split(lower(after), '[^a-z0-9_]+'), w -> w <> ''), 1, 2))")
    total = findings.agg(F.sum("label"), F.count("*")).first()
    base = math.log(((total[0] or 0) + 1) / ((total[1] or 0) - (total[0] or 0) + 1))
    words = findings.select("label", F.explode(F.array_distinct(said)).alias("w")).groupBy("w").agg(F.sum("label").alias("p"), F.count("*").alias("n")).where(F.col("n") >= least)
    return {r.w: math.log((r.p + 1) / (r.n - r.p + 1)) - base for r in words.orderBy(F.desc("n"), "w").limit(MOST_ODDS).collect()}


def train(findings: DataFrame, words: list[str], trees: int = 32, depth: int = 10, seed: int = 3) -> Scanner:
    """The scanner for a table of labelled findings (before, candidate, after, label) and a dictionary."""
    spark = findings.sparkSession
    rows = findings.select("before", "candidate", "after", F.col("label").cast("double").alias("label")).where("candidate is not null and label in (0.0, 1.0)")
    rows = cut(rows.na.fill("", ["before", "after"]))
    terms = spark.createDataFrame([(w,) for w in words], "t string")
    scanner = Scanner(Lexicon.of(terms, MOST_WORDS), chain(words), {})
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        scanner.share = 1.0 if 1.0 in counts else 0.0
        return scanner
    scanner.odds = neighbour_odds(rows)
    together = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")
    scanner.forest = PipelineModel([together, forest.fit(together.transform(scanner.features(rows).select("label", *FEATURES)))])
    return scanner


def _scored(docs: DataFrame, scanner: Scanner, least: float) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = candidates(docs)
    if scanner.forest is None:
        score = F.lit(scanner.share)
    else:
        rows = scanner.forest.transform(scanner.features(rows))
        score = F.element_at(vector_to_array("_probability"), 2)
    return rows.select("doc_id", "_th", "place", "candidate", score.alias("score"), (score >= least).alias("is_secret"))


def scan(docs: DataFrame, findings: DataFrame, words: list[str], least: float = 0.5) -> DataFrame:
    """(doc_id, place, candidate, score, is_secret): every candidate of ``docs`` (doc_id, text) with its verdict."""
    return _scored(docs.select("doc_id", "text"), train(findings, words), least).drop("_th")


OWN = ("doc_id", "text")


def redact(docs: DataFrame, findings: DataFrame, words: list[str], least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (doc_id, text, ...) with every secret replaced by ``mark``; rows without a doc_id too."""
    hits = _scored(docs.select(*OWN), train(findings, words), least).where("is_secret").groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_h")).agg(F.collect_set("place").alias("_places"))
    both = boxed(docs, *OWN).withColumn("_th", F.xxhash64("text")).join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")), "left")
    swapped = F.transform(pieces(F.col("text")), lambda p, i: F.when((i % 2 == 1) & F.array_contains("_places", F.floor(i / 2).cast("int")), F.lit(mark)).otherwise(p))
    text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.array_join(swapped, ""))
    return unboxed(both.withColumn("text", text), docs.columns, OWN)
