"""Secret scans with a random forest that removes false positives; DataFrame functions only.

Candidates are long runs of key characters with a digit, values of 8 characters and more that are assigned to a key name,
and private-key blocks of any length. Each becomes a vector: length, character transitions, shares of character classes, dictionary coverage, path, and neighbouring words. The forest is trained by Spark's own
learner on labelled findings (`labelled_findings`: made from a range of numbers by SQL functions, a fixed number of rows)
and compiled into one column expression: the share of its trees that vote for a secret.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What candidates look like, and words that speak for or against a secret.
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^\"'<>]*?-----END [A-Z ]{0,20}PRIVATE KEY-----"
# '=' only ends a run as padding, so that the value of an assignment or a parameter is a candidate of its own.
RUN = r"(?=[A-Za-z_+/.\-]*+[0-9])[A-Za-z0-9_+/.\-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/=.\-]))?"
# The value that is assigned to a key name needs neither a digit nor that length.
VALUE = r"(?<=[=:\"'] ?|bearer )(?<=bearer |(?:token|secret|password|passwd|pwd|api_?key|access_?key|auth|credentials?|private_?key)[A-Za-z_]{0,8}[\"']? ?[=:] ?[\"']?)[A-Za-z0-9_+/.\-!@#$%^*?~]{8,}+"
CANDIDATE = rf"{PEM}|(?<![A-Za-z0-9_+/.\-])(?i)(?:{RUN}|{VALUE})(?-i)"
FOR_WORDS = "token|secret|passw|pwd|apikey|api_key|api key|access_key|access key|private_key|auth|bearer|credential|client_secret|signature|session"
AGAINST_WORDS = "sha1|sha256|md5|commit|checksum|digest|uuid|revision|hash|version|image|etag|build|order|invoice|phone|card|isbn|file|path|url|http|href|src|mail|@"
KNOWN_PREFIX = "^(AKIA|ASIA|gh[pousr]_|github_pat_|sk-|sk_live_|rk_live_|xox[abprs]-|eyJ|AIza|glpat-|npm_|hf_)"
DICTIONARY = (
    "about account after again also application archive article back because been before between book build business class client code com common company config content copy could current customer data date default "
    "design detail develop document down each email error event example file first form from function general group have help high home house html http image index info information into item just know last level "
    "library light like line link list local long look mail main make management manual market message model more most name national network news number online only open option order other over page part path people "
    "photo place plan point post press price private process product program project public question read record release report request research resource response result review right sample school search section "
    "server service set share site software some source standard start state static story style such support system table take test text that their them then there these they thing this those time title type under "
    "update upload used user value version video view want water week well what when where which will with word work world would www year your"
)
FEATURES = ("length", "transitions", "distinct", "digits", "upper", "dictionary", "vowels", "hex", "path", "dots", "for_words", "against_words", "quoted", "prefix", "separators", "pem")
#: Labelled findings that the forest is trained on, its trees and their depth, and the votes that make a secret.
LABELLED_ROWS, TREES, DEPTH, LEAST_VOTE = 6000, 16, 6, 0.5
NEIGHBOURS = 40


def feature_struct(text: Column, before: Column, after: Column) -> Column:
    """The vector of a candidate with the NEIGHBOURS characters before and after it."""
    low, near = F.lower(text), F.lower(before)
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def without(pattern: str, of: Column = text) -> Column:
        return n - F.length(F.regexp_replace(of, F.lit(pattern), F.lit("")))

    letters = F.greatest(without("[A-Za-z]"), F.lit(1.0))
    words = "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w)))
    made = {
        "length": n, "transitions": F.length(F.regexp_replace(text, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit("x"))) / n, "distinct": F.size(F.array_distinct(F.split(text, ""))) / F.least(n, F.lit(100.0)),
        "digits": without("[0-9]") / n, "upper": without("[A-Z]") / n, "dictionary": without(words, low) / n, "vowels": without("[aeiou]", low) / letters, "hex": text.rlike("^[0-9a-fA-F]+$").cast("double"),
        "path": (without("/") + F.when(before.rlike("[/\\\\]$"), 1.0).otherwise(0.0) + F.when(after.rlike("^[/\\\\]"), 1.0).otherwise(0.0)), "dots": without("[.]"),
        "for_words": near.rlike(f"({FOR_WORDS})[^a-z]{{0,4}}[a-z]{{0,8}}[^a-z]{{0,8}}$").cast("double"), "against_words": near.rlike(f"({AGAINST_WORDS})[^a-z]{{0,4}}[a-z]{{0,8}}[^a-z]{{0,8}}$").cast("double"),
        "quoted": before.rlike("[\"'=:`]\\s?$").cast("double"), "prefix": text.rlike(KNOWN_PREFIX).cast("double"), "separators": without("[_\\-]"), "pem": text.startswith("-----BEGIN").cast("double"),
    }
    return F.struct(*(F.coalesce(made[k], F.lit(0.0)).alias(k) for k in FEATURES))


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS, first: int = 0) -> DataFrame:
    """text, before, after, label, kind: `rows` findings of known kinds with random bodies and contexts, by their numbers."""
    r = spark.range(first, first + rows).select("id", F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512).alias("h"))
    pick = lambda k, xs: F.get(F.array(*map(F.lit, xs)), (F.abs(F.xxhash64("id", F.lit(k))) % F.lit(len(xs))).cast("int"))
    number = lambda k, m: F.abs(F.xxhash64("id", F.lit(k))) % F.lit(m)
    mixed = F.translate(F.base64(F.unhex(F.col("h"))), "+/=", "xYz")
    digits = F.regexp_replace(F.col("h"), "[a-f]", "")
    words = lambda k: pick(k, DICTIONARY.split()[::3])
    odd = pick("odd", ["thandered", "ionesthat", "reveredon", "entlasque", "cionmente", "heiteinver", "auxelletion", "andereth"])
    dated = F.concat(F.lit("20"), F.lpad(number("y", 25).cast("string"), 2, "0"), F.lit("-"), F.lpad((number("m", 12) + 1).cast("string"), 2, "0"))
    part = lambda n: F.left(F.col("h"), F.lit(n))
    uuid = F.concat(part(8), F.lit("-"), F.substring("h", 9, 4), F.lit("-4"), F.substring("h", 14, 3), F.lit("-a"), F.substring("h", 18, 3), F.lit("-"), F.substring("h", 21, 12))
    secret_context, plain = [
        "token = \"", "secret: '", "api_key=", "password = \"", "Authorization: Bearer ", "client_secret=\"", "access_key: ", "credentials = '", "AWS_ACCESS_KEY_ID=", "export GITHUB_TOKEN=", "\nDB_PASSWORD=",
        "https://example.com/cb?access_token=", "https://example.com/cb?page=2&auth_token=", "SESSION_SECRET: ",
    ], ["the ", "see ", "of ", "and (", "\n", ". ", ""]
    quoted = ["password = \"", "secret: '", "passwd=\"", "db_password: \"", "credentials = '", "pwd = '"]
    against = ["commit ", "sha256:", "md5 = ", "checksum: ", "uuid=", "revision ", "etag: \"", "build-", "image@sha256:", "COMMIT_SHA=", "\nIMAGE_DIGEST=", "https://example.com/a?version=", "https://example.com/a?page=2&hash=", "md5="]
    kinds = [  # (text, contexts before, label)
        (part(40), secret_context, 1), (part(32), secret_context, 1), (F.left(mixed, F.lit(40)), secret_context, 1), (F.left(mixed, F.lit(24)), secret_context, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.left(mixed, F.lit(16)))), [*plain, *secret_context], 1), (F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), [*plain, *secret_context], 1),
        (F.concat(F.lit("sk-"), F.left(mixed, F.lit(48))), [*plain, *secret_context], 1), (F.concat(F.lit("eyJhbGciOi"), F.left(mixed, F.lit(20)), F.lit("."), F.left(F.reverse(mixed), F.lit(60))), [*plain, *secret_context], 1),
        (F.concat(F.lit("xoxb-"), F.left(digits, F.lit(12)), F.lit("-"), F.left(mixed, F.lit(24))), [*plain, *secret_context], 1),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed, F.lit("\n-----END RSA PRIVATE KEY-----")), plain, 1),
        (part(40), against, 0), (part(64), against, 0), (uuid, [*plain, *against, "https://example.com/"], 0), (F.concat(words("a"), F.lit("/"), words("b"), F.lit("/"), words("c"), F.lit("-"), number("f", 99).cast("string"), F.lit(".html")), [*plain, "https://", "file: /"], 0),
        (F.concat(F.lit("mail"), number("f", 99).cast("string"), F.lit(".example.com")), ["local.92@", "me@", "you.too@"], 0), (F.concat(words("a"), F.lit("_"), words("b"), F.lit("_"), words("c"), F.lit("_v"), number("f", 20).cast("string")), plain, 0),
        (F.left(digits, F.lit(16)), [*plain, "card ", "order "], 0), (F.concat(dated, F.lit("-"), words("a"), F.lit("-"), words("b")), plain, 0), (F.concat(odd, odd, number("f", 9).cast("string")), plain, 0),
        (F.concat(words("a"), words("b"), words("c"), number("f", 2000).cast("string")), [*plain, "id=\"", "name: "], 0), (F.concat(F.lit("1."), number("f", 30).cast("string"), F.lit("."), number("g", 30).cast("string"), F.lit("-beta."), words("a")), ["version ", "v", *plain], 0),
        (F.upper(F.concat(words("a"), F.lit("_"), pick("name", ["access_token", "secret_key", "api_key", "password"]), F.lit("_"), number("f", 20).cast("string"))), [*plain, "export ", "\nDEBUG=1\n"], 0),
        (F.left(mixed, F.lit(13)), secret_context, 1), (F.concat(words("a"), F.initcap(words("b")), F.initcap(words("c")), F.initcap(words("d"))), quoted, 1),
        (F.concat(words("a"), pick("mark", ["!", "$", "#", "@"]), F.initcap(words("b")), number("f", 900).cast("string")), secret_context, 1),
        (F.concat(words("a"), pick("tail", ["ingly", "ification", "erable", "ments"])), ["password: ", "token: ", "the secret: ", "auth = ", "credentials: "], 0),
        (F.concat(words("a"), F.lit("."), words("b"), F.lit("_"), words("c")), ["token = ", "password=", "api_key = ", "secret: "], 0),
        (F.concat(F.lit("----------"), number("f", 2000).cast("string"), F.lit("----------")), plain, 0), (F.concat(odd, F.lit("."), odd, F.lit("."), number("f", 99).cast("string")), plain, 0),
    ]
    kind = F.col("id") % F.lit(len(kinds))
    text = before = label = None
    for k, (t, b, y) in enumerate(kinds):
        text = F.when(kind == k, t) if text is None else text.when(kind == k, t)
        before = F.when(kind == k, pick("before", b)) if before is None else before.when(kind == k, pick("before", b))
        label = F.when(kind == k, F.lit(y)) if label is None else label.when(kind == k, F.lit(y))
    lead = F.concat(odd, F.lit(" "), words("lead"), F.lit(" "))
    made = r.select(text.alias("text"), F.concat(lead, before).alias("before"), odd.alias("odd"), label.cast("double").alias("label"), kind.alias("kind"))
    # a quote is closed; a column that is used again is one column here, else its expression is compiled anew at each place
    closing = F.when(F.col("before").rlike("[\"']$"), F.right("before", F.lit(1))).otherwise(F.lit(""))
    return made.select("text", "before", F.concat(closing, F.lit(" "), "odd").alias("after"), "label", "kind")


def labelled_vectors(findings: DataFrame) -> DataFrame:
    """Vectors and labels of the candidates that a scan of the whole texts finds in the labelled parts."""
    whole = findings.select(F.concat("before", "text", "after").alias("whole"), F.length("before").alias("a"), F.length(F.concat("before", "text")).alias("b"), "label")
    found = _with_vectors(whole, "whole").where(F.size("_runs") > 0).select("a", "b", "label", F.explode(F.transform("_vectors", lambda v: F.struct(F.get("_starts", v["k"]).alias("at"), v["run"].alias("run"), v["f"].alias("f")))).alias("x"))
    return found.where((F.col("x.at") < F.col("b")) & (F.col("x.at") + F.length("x.run") > F.col("a"))).select("x.f.*", "label")


def fit_forest(spark: SparkSession, findings: DataFrame | None = None) -> list[tuple]:
    """Trees as nested tuples (feature, threshold, left, right) or a vote. findings: text, before, after, label.

    Findings and their vectors are kept while the forest grows: the learner reads them once a level, and a plan that makes
    and scans the findings in one is too large to be compiled."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    findings = (labelled_findings(spark) if findings is None else findings).select("text", "before", "after", "label").persist()
    rows = labelled_vectors(findings).coalesce(4).persist()
    try:
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        model = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=13, featureSubsetStrategy="onethird", cacheNodeIds=False).fit(data)
    finally:
        rows.unpersist()
        findings.unpersist()
    return parse_forest(model.toDebugString)


@lru_cache(maxsize=4)
def _trained(application: str) -> tuple:
    return tuple(fit_forest(SparkSession.active()))


def trained_forest(spark: SparkSession) -> list[tuple]:
    """The forest of the built-in findings, fitted once in an application."""
    return list(_trained(spark.sparkContext.applicationId))


_LINE = re.compile(r"^(\s*)(?:(If|Else) \(feature (\d+) (?:<=|>) ([-+.\dEe]+)\)|Predict: ([\d.]+))")


def parse_forest(described: str) -> list[tuple]:
    lines = [m for m in map(_LINE.match, described.splitlines()) if m]
    at, trees = 0, []

    def node():
        nonlocal at
        m = lines[at]
        at += 1
        if m[5] is not None:
            return float(m[5])
        left = node()
        at += 1  # Else
        return int(m[3]), float(m[4]), left, node()

    while at < len(lines):
        trees.append(node())
    return trees


def forest_score(vector: Column, trees: list[tuple]) -> Column:
    """The share of trees that vote for a secret, over a column with the fields of FEATURES."""

    def column(t) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        f, threshold, left, right = t
        if left == right:
            return column(left)
        return F.when(vector[FEATURES[f]] <= F.lit(threshold), column(left)).otherwise(column(right))

    total = F.lit(0.0)
    for t in trees:
        total = total + column(t)
    return total / F.lit(float(max(len(trees), 1)))


def _with_vectors(docs: DataFrame, text: str) -> DataFrame:
    """Adds _gaps (the text between candidates), _runs, and where there are any _starts and _vectors. What stands before a
    candidate includes the candidate before it, which may be the name of a key."""
    t = F.col(text)
    has = t.rlike(CANDIDATE)
    docs = docs.withColumn("_gaps", F.when(has, F.split(t, CANDIDATE, -1)).otherwise(F.array(t)))
    docs = docs.withColumn("_runs", F.when(has, F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    lengths = F.aggregate(
        F.sequence(F.lit(1), F.size("_runs")), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, k: F.struct((s["at"] + F.length(F.get("_gaps", k - F.lit(1))) + F.length(F.get("_runs", k - F.lit(1)))).alias("at"), F.array_append(s["starts"], s["at"] + F.length(F.get("_gaps", k - F.lit(1)))).alias("starts")),
    )["starts"]
    vectors = F.transform(
        "_runs",
        lambda run, k: F.struct(
            run.alias("run"), k.alias("k"), feature_struct(run, F.right(F.concat(F.when(k > 0, F.get("_runs", k - F.lit(1))).otherwise(F.lit("")), F.get("_gaps", k)), F.lit(NEIGHBOURS)), F.left(F.get("_gaps", k + F.lit(1)), F.lit(NEIGHBOURS))).alias("f")
        ),
    )
    some = F.size("_runs") > 0
    return docs.withColumn("_starts", F.when(some, lengths)).withColumn("_vectors", F.when(some, vectors))


def with_findings(docs: DataFrame, trees: list[tuple], text: str = "text") -> DataFrame:
    """Adds _gaps (the text between candidates) and _found: array of (start, n_chars, candidate, score), start from 0 in
    characters. Texts without a candidate, and null ones, have an empty array."""
    docs, some = _with_vectors(docs, text), F.size("_runs") > 0
    found = F.transform(
        "_vectors",
        lambda v: F.struct(F.get("_starts", v["k"]).cast("long").alias("start"), F.length(v["run"]).cast("long").alias("n_chars"), v["run"].alias("candidate"), forest_score(v["f"], trees).alias("score")),
    )
    return docs.withColumn("_found", F.when(some, found).otherwise(F.array().cast("array<struct<start:bigint,n_chars:bigint,candidate:string,score:double>>"))).drop("_runs", "_starts", "_vectors")


def scan(docs: DataFrame, trees: list[tuple]) -> DataFrame:
    """One row per candidate: doc_id, start, n_chars, candidate, score and is_secret.

    docs: doc_id and text; other columns are ignored. Null and empty texts, and those without a candidate, give no row;
    repeated rows give their candidates each, a null doc_id stays null."""
    found = with_findings(docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE)), trees).select("doc_id", F.explode("_found").alias("x"))
    return found.select("doc_id", "x.start", "x.n_chars", "x.candidate", "x.score", (F.col("x.score") >= LEAST_VOTE).alias("is_secret"))


def redact_secrets(docs: DataFrame, trees: list[tuple], label: str = "[SECRET]") -> DataFrame:
    """The same rows with secrets replaced in text (and n_chars counted again where that column exists); candidates that
    the forest takes for false positives stay."""
    own = [f.name for f in docs.schema.fields if f.name != "text"]
    held = with_findings(docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row_fields"), "text"), trees)
    joined = F.concat(
        F.get("_gaps", F.lit(0)),
        F.array_join(F.transform("_found", lambda x, k: F.concat(F.when(x["score"] >= LEAST_VOTE, F.lit(label)).otherwise(x["candidate"]), F.get("_gaps", k + F.lit(1)))), ""),
    )
    out = held.withColumn("text", F.when(F.size("_found") > 0, joined).otherwise(F.col("text")))
    counted = {"n_chars": F.coalesce(F.length("text").cast("long"), F.col("row_fields.n_chars"))} if "n_chars" in own else {}
    made = {c: counted.get(c, F.col(f"row_fields.`{c}`")) for c in own} | {"text": F.col("text")}
    return out.select(*(made[f.name].cast(f.dataType).alias(f.name) for f in docs.schema.fields))
