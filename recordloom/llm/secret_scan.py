"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Everything on this path is a DataFrame or SQL expression; the forest is Spark's own. A candidate is what follows a credential's
name and an assignment, the password in a URL, a private key's block, or any long run of key characters. Its features are its
length, the shares and changes of its character classes, how usual its letter transitions are, how much of it a dictionary
covers, its entropy, the words around it and the path of its document. Dictionary and transitions come from a word list that
``lexicon`` reads (the vocabulary file of a public tokenizer will do), as a table with the file's digest; both are met by one join.

The forest is trained from labelled findings: any table with the columns of ``FINDING``, such as one that was written from
reviewed findings; ``generated_findings`` makes one from a rule, of real key formats and of the usual false positives.

A text is parted at its candidates into the texts between them and the candidates themselves, which together are the
text again, so that redacting changes nothing else. Positions count characters from 0. A secret's own text is not part of a
finding; its digest is.

Defined cases: null and empty texts have no candidate; very long texts are scanned whole (a private key's block of more than 16,384
characters counts by its lines); equal secrets in one text are findings of their own; repeated rows give repeated findings;
a null path counts as empty; an empty table gives no rows; further columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.rows import need
from recordloom.session import Workspace, spread

TREES, DEPTH, SEED = 24, 8, 5
THRESHOLD = 0.5
CONTEXT = 64

_NAMES = "password|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key"
_ASSIGNED = rf"""(?=[pstcaPSTCA])(?i:{_NAMES})["']{{0,1}}\s{{0,2}}[:=]\s{{0,2}}["']{{0,1}}"""
_AT_HOST = r"""://[^\s/:@"']{1,64}+:"""
_KEY = "-----BEGIN [A-Z0-9 ]{0,32}PRIVATE KEY(?: BLOCK)?-----"
#: Of a credential's name what is assigned; the password of a URL; a private key; a long run of key characters.
CANDIDATE = rf"""{_ASSIGNED}[^\s"']{{8,}}+|{_AT_HOST}[^\s/@"']{{4,128}}+(?=@)|{_KEY}[\s\S]{{1,16384}}?-----END [A-Z0-9 ]{{0,32}}PRIVATE KEY(?: BLOCK)?-----|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{20,}}+={{0,2}}"""
#: What of a candidate comes before the secret itself.
LEAD = rf"^(?:{_ASSIGNED}|{_AT_HOST})"

FEATURES = (
    "n", "digits", "uppers", "lowers", "signs", "runs", "distinct", "entropy", "transitions", "vowels", "words", "hex", "decimal", "uuid", "known", "block", "at_host", "password_before",
    "slashes", "name_before", "assigned", "quoted", "hash_before", "sample_near", "sample_inside", "sample_path", "code_path",
)

FINDING = "secret string, before string, after string, path string, label int"


def lexicon(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """key, weight: the words of at least ``least`` letters that a byte-level vocabulary file (JSON) has with a blank before them,
    under ``w:word`` with their length, and the pairs of letters in them, under ``p:ab`` with the logarithm of how often the second
    follows the first (never less often than once in a thousand). ``file:`` paths are read where the tasks run."""
    raw = spark.read.text(path if ":" in path else f"file:{path}", wholetext=True)
    words = raw.select(F.explode(F.map_keys(F.from_json("value", "model struct<vocab: map<string,int>>")["model"]["vocab"])).alias("entry"))
    words = words.where(F.col("entry").rlike(rf"^\u0120[A-Za-z]{{{least},}}$")).select(F.lower(F.substring("entry", 2, 64)).alias("word")).distinct()
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("of"))
    usual = pairs.join(F.broadcast(firsts), F.substring("pair", 1, 1) == F.col("a")).select(F.concat(F.lit("p:"), "pair").alias("key"), F.greatest(F.log(F.col("n") / F.col("of")), F.lit(RARE)).alias("weight"))
    return words.select(F.concat(F.lit("w:"), "word").alias("key"), F.length("word").cast("double").alias("weight")).unionByName(usual)


#: Logarithm of a transition that no word has, and rows of a lexicon that are sent to every task, at most.
RARE, LEXICON_ROWS = -6.9, 500_000


def _features() -> dict[str, Column]:
    s, n = F.col("secret"), F.length("secret")
    share = lambda drop: (n - F.length(F.regexp_replace(s, drop, ""))) / n
    classes = F.translate(s, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    chars = F.array_distinct(F.split(s, ""))
    part = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    bits = F.aggregate(F.transform(chars, part), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    has = lambda c, pattern: F.coalesce(c, F.lit("")).rlike(pattern).cast("double")
    near = F.concat_ws(" ", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    samples = "(?i)(example|sample|dummy|placeholder|changeme|change[_-]me|your[_-]|insert|xxxx|fake|redacted|12345)"
    return {
        "n": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        "runs": F.length(F.regexp_replace(F.regexp_replace(classes, "[^aA0]", "-"), r"(.)\1+", "$1")) / n,
        "distinct": F.size(chars) / n,
        "entropy": bits,
        "transitions": F.coalesce(F.col("usual") / F.nullif(F.col("n_pairs"), F.lit(0)), F.lit(RARE)),
        "vowels": share("(?i)[aeiou]"),
        "words": F.coalesce("covered", F.lit(0.0)) / n,
        "hex": has(s, "^([0-9a-f]+|[0-9A-F]+)$"),
        "decimal": has(s, "^[0-9]+$"),
        "uuid": has(s, "(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
        "known": has(s, "^(AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|AIza|(sk|pk|rk)[-_](live|test|proj|ant)|glpat-|eyJ|npm_|pypi-|SG\\.|shp(at|ss)_|dop_v1_)"),
        "block": has(s, "^-----BEGIN "),
        "at_host": has(F.col("before"), r"://[^\s/:@]+:$"),
        "password_before": has(F.col("before"), r"(?i)(password|passwd|pwd)\W{0,6}$"),
        "slashes": n - F.length(F.replace(s, F.lit("/"), F.lit(""))),
        "name_before": has(F.col("before"), rf"(?i)({_NAMES}|bearer|authorization)\W{{0,12}}$"),
        "assigned": has(F.col("before"), r"""[:=]\s{0,2}["']?$"""),
        "quoted": has(F.col("before"), "[\"']$"),
        "hash_before": has(F.col("before"), r"(?i)(sha-?\d*|md5|checksum|commit|digest|hash|revision|etag|uuid|guid|integrity|blob|tree|parent)\W{0,12}$"),
        "sample_near": has(near, samples),
        "sample_inside": has(s, samples),
        "sample_path": has(F.col("path"), r"(?i)(test|example|sample|fixture|mock|doc)"),
        "code_path": has(F.col("path"), r"(?i)\.(py|js|ts|java|go|rb|php|env|ya?ml|json|ini|cfg|conf|sh|tf)$"),
    }


def _looked_up(findings: DataFrame, words: DataFrame) -> DataFrame:
    """The findings (a written table, numbered by ``finding``) with usual, n_pairs and covered: sums over their letter pairs and the
    words that the dictionary has."""
    low = F.lower("secret")
    runs = F.regexp_extract_all(F.regexp_replace("secret", "([a-z])([A-Z])", "$1 $2"), F.lit("[A-Za-z]{2,64}"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.concat(F.lit("p:"), F.substr(low, i, F.lit(2))))
    keys = F.concat(F.filter(pairs, lambda p: p.rlike("^p:[a-z]{2}$")), F.transform(runs, lambda w: F.concat(F.lit("w:"), F.lower(w))))
    each = findings.select("finding", F.explode(keys).alias("key"))
    lexed = each.join(F.broadcast(words) if words.count() <= LEXICON_ROWS else words, "key", "left")
    is_pair = F.startswith("key", F.lit("p:"))
    sums = lexed.groupBy("finding").agg(F.sum(F.when(is_pair, F.coalesce("weight", F.lit(RARE)))).alias("usual"), F.count_if(is_pair).alias("n_pairs"), F.sum(F.when(~is_pair, F.col("weight"))).alias("covered"))
    return findings.join(sums, "finding", "left")


def featured(findings: DataFrame, words: DataFrame, workspace: Workspace) -> DataFrame:
    """The findings with a vector of features."""
    rows = workspace.keep(findings.withColumn("finding", F.monotonically_increasing_id()), f"findings-{uuid.uuid4().hex[:8]}")
    cast = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in _features().items()}
    out = _looked_up(rows, words).withColumns({f"f_{k}": cast[k] for k in FEATURES})
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(out).drop("finding", "usual", "n_pairs", "covered", *[f"f_{k}" for k in FEATURES])


def generated_findings(spark: SparkSession, each: int = 160) -> DataFrame:
    """Labelled findings from a rule: key formats and look-alikes, ``each`` of a kind, all from hashes of a counter."""
    h = lambda salt, fn="sha1": F.expr(f"{fn}(concat('{salt}', cast(id as string)))")
    b64 = lambda salt, n: F.substring(F.translate(F.base64(F.unhex(F.concat(h(salt), h(salt + "x")))), "=\n\r", ""), 1, n)
    mixed = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(salt), h(salt + "x"), h(salt + "y")))), "[^A-Za-z0-9]", ""), 1, n)
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(values))) + 1).cast("int"))
    syllables = ["ment", "tion", "ing", "er", "schaft", "lich", "keit", "the", "re", "con", "ver", "aus", "able", "ción", "eau", "que", "ha", "on", "es", "an"]
    word = lambda salt, n: F.regexp_replace(F.concat(*[pick(f"{salt}{k}", syllables) for k in range(n)]), "[^a-z]", "")
    name = pick("name", ["token", "secret", "api_key", "password", "apiKey", "access_key", "client_secret", "auth_key", "TOKEN", "credential"])
    assign = F.concat(word("l", 2), F.lit(" "), name, pick("as", [" = \"", ": \"", "=", " = '", ": ", "=\""]))
    prose = F.concat(word("l", 2), F.lit(" "), word("m", 1), F.lit(" "))
    hashed = F.concat(word("l", 2), pick("hs", [" sha1: ", " commit ", " md5 = ", " checksum=\"", " digest: ", " revision ", " etag=\"", " integrity sha256-", " parent ", " uuid="]))
    real, none = 1, 0
    human = F.concat(word("hu", 2), F.substring(F.conv(F.substring(h("hn"), 1, 15), 16, 10), 1, 3), pick("hv", ["", "abc", "X", "pass"]))
    secret_word = F.concat(pick("sw", ["DB_PASSWORD", "password", "passwd", "pwd", "ADMIN_PASSWORD", "user.password", "secret"]), pick("as2", ["=", ": ", " = ", "=\"", ": \""]))
    kinds = [
        (h("a"), assign, real), (h("b", "md5"), assign, real), (F.sha2(F.concat(F.lit("c"), F.col("id").cast("string")), 256), assign, real), (F.upper(h("d")), assign, real),
        (b64("e", 40), assign, real), (mixed("f", 32), assign, real), (mixed("g", 24), assign, real), (mixed("g2", 16), assign, real),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(h("i"), 1, 16))), pick("p1", ["key ", "id: ", "aws "]), real), (F.concat(F.lit("ghp_"), mixed("j", 36)), prose, real),
        (F.concat(F.lit("AIza"), mixed("k", 35)), prose, real), (F.concat(F.lit("sk_live_"), mixed("l", 24)), prose, real), (F.concat(F.lit("eyJ"), b64("m", 40)), F.lit("Authorization: Bearer "), real),
        (F.concat(F.lit("xoxb-"), F.substring(F.conv(F.substring(h("sl"), 1, 15), 16, 10), 1, 11), F.lit("-"), mixed("sm", 24)), prose, real), (F.concat(F.lit("glpat-"), mixed("gl", 20)), prose, real),
        (F.concat(F.lit("npm_"), mixed("np", 36)), assign, real), (F.concat(F.lit("SG."), mixed("sg", 22), F.lit("."), mixed("sh", 40)), assign, real),
        (F.concat(F.lit("-----BEGIN "), pick("pk", ["RSA ", "EC ", "", "OPENSSH ", "DSA "]), F.lit("PRIVATE KEY-----\n"), b64("pa", 40), F.lit("\n"), b64("pb", 40), F.lit("\n"), b64("pc", 30), F.lit("\n-----END "), pick("pk", ["RSA ", "EC ", "", "OPENSSH ", "DSA "]), F.lit("PRIVATE KEY-----")), prose, real),
        (human, secret_word, real), (F.concat(human, pick("sg1", ["!", "#", "$", "@1", "%"])), secret_word, real), (mixed("h9", 12), secret_word, real),
        (human, F.concat(pick("db", ["postgres", "mysql", "amqp", "redis", "mongodb", "https"]), F.lit("://"), word("us", 1), F.lit(":")), real), (mixed("h8", 14), F.concat(pick("db", ["postgres", "mysql", "amqp", "redis", "mongodb", "https"]), F.lit("://"), word("us", 1), F.lit(":")), real),
        (F.concat(word("pl", 4), F.lit(",")), secret_word, none), (pick("pd", ["required", "optional", "undefined", "${DB_PASSWORD}", "<password>", "process.env.SECRET", "os.environ[KEY]", "getPassword()", "********", "null;null;"]), secret_word, none),
        (pick("pe", ["password", "${PASSWORD}", "<secret>", "$DB_PASS", "********"]), F.concat(pick("db", ["postgres", "mysql", "amqp"]), F.lit("://"), word("us", 1), F.lit(":")), none),
        (b64("im", 40), pick("data", ["url(data:image/png;base64,", "src=\"data:image/gif;base64,", "font/woff2;base64,"]), none), (F.concat(F.lit("https-"), word("ur", 5), F.lit("-"), word("us2", 5)), prose, none),
        (F.concat(word("c1", 2), F.initcap(word("c2", 3)), F.initcap(word("c3", 3)), F.initcap(word("c4", 2))), prose, none), (F.concat(F.lit("+"), F.substring(F.conv(F.substring(h("ph2"), 1, 15), 16, 10), 1, 12), F.lit("-"), F.substring(F.conv(F.substring(h("ph3"), 1, 15), 16, 10), 1, 8)), prose, none),
        (h("n"), hashed, none), (h("o", "md5"), hashed, none), (h("o2"), prose, none), (F.regexp_replace(h("q", "md5"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), prose, none),
        (word("r", 6), prose, none), (word("s", 8), prose, none), (F.initcap(word("s2", 7)), assign, none), (F.concat(word("t", 3), F.lit("-"), word("u", 3), F.lit("-"), word("v", 2)), prose, none),
        (F.concat(pick("d1", ["src/main/", "lib/", "/usr/share/", "assets/img/"]), word("w", 3), F.lit("/"), word("x", 3)), prose, none), (F.concat(word("w1", 2), F.lit("_"), word("w2", 2), F.lit("_"), word("w3", 2), F.lit("_id")), prose, none),
        (pick("ph", ["YOUR_API_KEY_HERE", "xxxxxxxxxxxxxxxxxxxxxxxx", "changeme_example_token", "insert-your-token-here", "example_secret_value", "REDACTED-REDACTED-REDACTED", "placeholder_password_1"]), assign, none),
        (F.regexp_replace(F.conv(F.substring(h("y"), 1, 15), 16, 10), "$", "0000000"), prose, none), (F.expr("repeat(element_at(array('-', '_', '=', 'A', '0', 'ab'), cast(pmod(id, 6) + 1 as int)), 32)"), prose, none),
        (F.initcap(word("z", 5)), F.concat(word("l", 2), F.lit(" the token: ")), none),
    ]
    after = pick("after", ["\" ", "\n", "' and ", " ", "\";"])
    path = pick("path", ["", "src0", "src7", "config.yml", "app.py", "README.md", "notes.txt", "web", "settings.env"])
    base = spark.range(0, each, 1, 1).select("id", after.alias("after"), path.alias("path"))
    some = lambda at: F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), s.alias("secret"), b.alias("before"), F.lit(label).alias("label")) for k, (s, b, label) in list(enumerate(kinds))[at : at + 8]]))
    parts = [base.select("id", some(at).alias("r"), "after", "path") for at in range(0, len(kinds), 8)]
    return reduce(DataFrame.unionByName, parts).select("id", "r.kind", "r.secret", "r.before", "after", "path", "r.label")


class Model:
    """The forest and the lexicon that its features are made with."""

    def __init__(self, forest: RandomForestClassificationModel, words: DataFrame):
        self.forest, self.words = forest, words


def train(findings: DataFrame, words: DataFrame, workspace: Workspace | None = None) -> Model:
    """The forest from labelled findings (columns of ``FINDING``)."""
    ws = workspace or Workspace(findings.sparkSession, "secret-training")
    words = ws.keep(words, "lexicon")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", subsamplingRate=0.8)
    return Model(forest.fit(featured(findings, words, ws)), words)


def _parted(documents: DataFrame) -> DataFrame:
    """Columns ``gaps`` and ``hits``: the texts between the candidates, one more than there are, and the candidates."""
    return documents.withColumns({"gaps": F.split("text", CANDIDATE, -1), "hits": F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))})


def _candidates(rows: DataFrame, *carried: str) -> DataFrame:
    """A row for each candidate of each row (row, path, gaps, hits and what is carried): at (from 0), secret, before, after, and
    the characters of the gap and of the lead before it. Of a gap only its length and its ends leave the row."""

    def one(hit: Column, i: Column) -> Column:
        gap, lead = F.get("gaps", i), F.regexp_extract(hit, LEAD, 0)
        before = F.right(F.concat(F.right(gap, F.lit(CONTEXT)), lead), F.lit(CONTEXT))
        parts = {"at": i, "secret": F.substr(hit, F.length(lead) + 1), "before": before, "after": F.left(F.get("gaps", i + 1), F.lit(CONTEXT)), "skipped": F.length(gap) + F.length(lead)}
        return F.struct(*[c.alias(k) for k, c in parts.items()])

    return rows.select("row", "path", *carried, F.explode(F.transform("hits", one)).alias("c")).select("row", "path", *carried, "c.*")


def _scored(candidates: DataFrame, model: Model, workspace: Workspace) -> DataFrame:
    found = featured(candidates, model.words, workspace)
    return model.forest.transform(found).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _path(documents: DataFrame, path: str | None) -> Column:
    return F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path and path in documents.columns else F.lit("")


def scan(documents: DataFrame, model: Model, path: str | None = "source", threshold: float = THRESHOLD, workspace: Workspace | None = None) -> DataFrame:
    """doc_id, start, n_chars, secret_sha256, score of every candidate that the forest takes for a secret. Only the texts with
    a candidate are parted, and only lengths and contexts of 64 characters leave a task."""
    ws = workspace or Workspace(documents.sparkSession, "secret-scan")
    wanted = ["doc_id", "text", *([path] if path and path in documents.columns and path not in ("doc_id", "text") else [])]
    rows = need(documents, *wanted).where(F.col("text").rlike(CANDIDATE)).select(F.monotonically_increasing_id().alias("row"), "doc_id", _path(documents, path).alias("path"), "text")
    cut = _candidates(_parted(rows), "doc_id")
    start = F.sum(F.col("skipped") + F.length("secret")).over(Window.partitionBy("row").orderBy("at")) - F.length("secret")
    placed = cut.select("doc_id", "path", "secret", "before", "after", start.alias("start"))
    found = _scored(placed, model, ws).where(F.col("score") >= threshold)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.length("secret").cast("long").alias("n_chars"), F.sha2("secret", 256).alias("secret_sha256"), F.round("score", 6).alias("score"))


def redact(documents: DataFrame, model: Model, path: str | None = "source", threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns and rows, with each secret replaced by ``mark``. Texts without a candidate pass as they
    are; the others are parted, written once under a row number, judged, and joined again by it."""
    workspace = Workspace(documents.sparkSession, "redaction")
    names = documents.columns
    clean = documents.where(~F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False)))
    hidden = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c != "text"], F.lit(0).alias("none"))
    rows = _parted(documents.where(F.col("text").rlike(CANDIDATE)).select(F.monotonically_increasing_id().alias("row"), hidden.alias("held"), _path(documents, path).alias("path"), "text")).drop("text")
    rows = workspace.keep(rows, "parted")
    judged = _scored(_candidates(rows.select("row", "path", "gaps", "hits")), model, workspace).where(F.col("score") >= threshold)
    secret = judged.groupBy("row").agg(F.collect_set(F.col("at").cast("int")).alias("secrets"))
    hit = F.transform("hits", lambda h, i: F.when(F.array_contains("secrets", i), F.concat(F.regexp_extract(h, LEAD, 0), F.lit(mark))).otherwise(h))
    text = F.concat(F.array_join(F.zip_with(F.slice("gaps", F.lit(1), F.size("hits")), hit, lambda g, h: F.concat(g, h)), ""), F.element_at("gaps", -1))
    back = rows.join(secret, "row", "left").withColumn("secrets", F.coalesce("secrets", F.array().cast("array<int>")))
    return clean.unionByName(back.select(*[text.alias("text") if c == "text" else F.col(f"held.c{k}").alias(c) for k, c in enumerate(names)]))


def default_model(spark: SparkSession) -> Model:
    """The forest of the generated findings, with the words of a public vocabulary file."""
    import public_tokenizers

    return train(generated_findings(spark), lexicon(spark, public_tokenizers.path("byte_bpe_50k.json")))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: findings in every document."""
    return scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), default_model(spark))
