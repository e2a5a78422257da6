"""Secret scans: candidates by pattern, false positives removed by a random forest.

Patterns find keys with a known prefix, values assigned to a telling name, and long
strings that hold a digit.  Each candidate is described by its whole length, its
characters, how much likelier its character transitions are in secrets than in other
findings (learnt from the labelled ones), the share that dictionary words cover, the
path it comes from and the words beside it.  A random forest, trained from labelled
findings with the very same SQL features, decides; it is rendered as one SQL
expression, so scanning and redaction are row-local SQL: no shuffle, no Python.

Labelled findings are a frame (before, value, after, path, label); a seeded rule makes
the default ones.  At most ``MAX_FINDINGS`` of them, by a hash, are read for training,
which runs on the driver.

Defined results: null and empty texts have no findings and stay as they are; a null
path counts as empty; repeated rows are scanned each for itself; positions count code
points from 0; other columns are carried by ``redact`` and ignored by ``scan``; working
columns are named ``__*``.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FINDINGS = 3000
TREES, DEPTH, SEED = 15, 6, 11

# Names that secrets are assigned to, words that speak for and against one, words of paths with samples.
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?"
FOR_IT = "password|passwd|pwd|secret|token|key|credential|credentials|auth|login|bearer"
AGAINST = "commit|sha|sha1|sha256|md5|hash|checksum|digest|revision|uuid|guid|etag|version|build|id|example|sample|placeholder|blob|tree"
SAMPLES = "test|tests|example|examples|sample|samples|fixture|fixtures|docs?|mock|demo"
# Words that no random string is made of.
DICTIONARY = (
    "example|password|changeme|placeholder|your|here|secret|token|test|sample|dummy|default|value|none|null|admin|user|"
    "insert|replace|redacted|the|and|for|with|from|this|that|have|file|path|name|config|server|client|service|model|data|"
    "table|index|order|customer|account|public|private|static|class|function|return|import|version|release|build|package|"
    "module|system|update|create|delete|select|http|www|com|org|key|api"
)

PATTERN = (
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    rf"|(?i:{NAMES})[\"']?\s{{0,3}}[:=]{{1,2}}\s{{0,3}}[\"']?[^\s\"'<>]{{6,}}+"
    r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
)
#: What stands before the value in an assignment.
HEAD = rf"^(?i:{NAMES})[\"']?\s{{0,3}}[:=]{{1,2}}\s{{0,3}}[\"']?"
TAIL = r"(?<![.,;:!?)\]}])[.,;:!?)\]}]++$"

FEATURES = ["chars", "digits", "uppers", "lowers", "transitions", "odds", "distinct", "covered", "hexadecimal", "assigned", "beside_for", "beside_against", "sample_path", "prefixed", "vowels"]


#: Characters that transitions are told by, regardless of case; digits are one, and so are all others.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
STATES = len(LETTERS) + 2


def states(value: Column) -> Column:
    """The state of each character, from 0."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), "[^a-z0]", ".")
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.when(c == "0", len(LETTERS)).when(c == ".", len(LETTERS) + 1).otherwise(F.ascii(c) - 97))


def transition_odds(findings: DataFrame) -> list[float]:
    """Log odds of each transition in secrets against other findings, smoothed: state times ``STATES`` plus next state."""
    s = states(F.coalesce("value", F.lit("")))
    pairs = F.transform(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda c, k: F.element_at(s, k + 1) * STATES + c)
    counts = np.ones((2, STATES, STATES))
    for r in findings.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count().collect():  # at most 2 * STATES * STATES rows
        counts[r["label"], r["pair"] // STATES, r["pair"] % STATES] += r["count"]
    share = counts / counts.sum(2, keepdims=True)
    return np.round(np.log(share[1] / share[0]), 6).ravel().tolist()


def features(value: Column, match: Column, before: Column, after: Column, path: Column, odds: list[float]) -> Column:
    """A struct of doubles for a candidate; ``before`` and ``after``: the text on its sides; ``odds``: as ``transition_odds`` gives them."""
    n = F.greatest(F.length(value), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / n

    dictionary = F.length(value) - F.length(F.regexp_replace(F.lower(value), f"(?:{DICTIONARY})", ""))
    words = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")
    beside = F.concat_ws(" ", F.reverse(F.slice(F.reverse(words(before)), 1, 2)), F.slice(words(after), 1, 1))
    table, s = F.array(*map(F.lit, odds)), states(value)
    jumps = F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.element_at(table, a * STATES + b + 1))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.struct(
        n.cast("double").alias("chars"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share("[a-z]").alias("lowers"),
        share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]").alias("transitions"),
        (F.aggregate(jumps, F.lit(0.0), lambda t, x: t + x) / n).alias("odds"),
        (F.size(F.array_distinct(F.split(value, ""))) / n).alias("distinct"),
        (dictionary / n).alias("covered"),
        flag(value.rlike("^[0-9a-fA-F]+$")).alias("hexadecimal"),
        flag(F.length(match) > F.length(value) + 2).alias("assigned"),
        flag(beside.rlike(rf"(?i)(?:^|[^a-z])(?:{FOR_IT})(?:[^a-z]|$)")).alias("beside_for"),
        flag(beside.rlike(rf"(?i)(?:^|[^a-z])(?:{AGAINST})(?:[^a-z]|$)")).alias("beside_against"),
        flag(path.rlike(rf"(?i)(?:^|[^a-z])(?:{SAMPLES})(?:[^a-z]|$)")).alias("sample_path"),
        flag(value.rlike("^(?:AKIA|ghp_|sk-|xox[a-z]-)")).alias("prefixed"),
        share("[aeiouAEIOU]").alias("vowels"),
    )


def default_findings(n: int = 1600, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings by rule: (before, value, after, path, label)."""
    r = random.Random(seed)
    hexa, upper, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    text = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    words = DICTIONARY.split("|")
    syllables = "th on an er he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    prose = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 4)))
    name = lambda: r.choice(["password", "token", "secret", "api_key", "access_key", "pwd"])
    assign = lambda: r.choice([' = "', "=", ": ", " = '", '="'])
    out = []
    for _ in range(n):
        before, after, path, kind = prose() + " ", " " + prose(), r.choice(["src0", "src7", "app/main.py", "lib/db.go", "web/config.ts", "crawl", ""]), r.random()
        if kind < 0.14:
            value, label = "AKIA" + text(upper, 16), 1
        elif kind < 0.27:
            before, value, label = before + name() + assign(), text(r.choice([hexa, hexa, "0123456789" * 4 + hexa]), r.choice([12, 16, 17, 18, 20, 24, 32, 40, 64])), 1  # some of almost only digits
        elif kind < 0.36:
            before, value, label = before + name() + assign(), text(base + "!@#%_-", r.randint(10, 48)), 1
        elif kind < 0.42:
            before, value, label = before + r.choice(["bearer ", "secret key ", "login with token ", "credentials "]), text(base, r.randint(24, 64)), 1
        elif kind < 0.46:
            value, label = r.choice(["ghp_", "sk-", "xoxb-"]) + text(base[:62], r.randint(30, 40)), 1
        elif kind < 0.55:
            before, value, label = before + r.choice(["commit ", "sha256 ", "md5: ", "revision ", "checksum ", "blob ", "tree ", "digest="]), text(hexa, r.choice([32, 40, 64])), 0
        elif kind < 0.62:
            value, label = "-".join(text(hexa, k) for k in (8, 4, 4, 4, 12)), 0
            before += r.choice(["uuid ", "id ", "", "guid="])
        elif kind < 0.72:
            sep = r.choice(["_", "-", "/", ""])
            value, label = sep.join(r.choice(words) for _ in range(r.randint(4, 8))) + str(r.randint(0, 99)), 0
        elif kind < 0.79:
            before, value, label = before + name() + assign(), r.choice(["your_", "example_", "changeme_", "dummy_", "placeholder_", "xxxxxxxx", "********", "${", "<insert_"]) + r.choice(["password", "token_here", "secret", "xxxxxx", "value1", "key_123"]), 0
        elif kind < 0.85:
            value, label = "".join(r.choice(syllables) for _ in range(r.randint(9, 16))) + str(r.randint(0, 9)), 0
        elif kind < 0.92:
            value, label = text("0123456789", r.randint(20, 32)), 0
        else:
            path = r.choice(["tests/fixtures/a.py", "docs/guide.md", "examples/demo.ts", "test/mock_keys.go"])
            before, value, label = before + name() + assign(), r.choice(["test", "sample", "example"]) + text(hexa, r.randint(8, 24)), 0
        out.append((before, value, after, path, label))
    return out


def findings_frame(spark: SparkSession, findings: list[tuple[str, str, str, str, int]]) -> DataFrame:
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("${", "$\\{") + "'"
    rows = ",".join(f"({quote(b)},{quote(v)},{quote(a)},{quote(p)},{y})" for b, v, a, p, y in findings)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS f(before, value, after, path, label)")


class Forest:
    """Gini trees over bootstrap samples, with a random part of the features at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, odds: list[float], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> None:
        self.odds = odds
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            at = rng.integers(0, len(y), len(y)) if len(y) else np.zeros(0, np.int64)
            self.trees.append(self.grow(x[at], y[at], depth, rng))

    def grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
        share = float(y.mean()) if len(y) else 0.0
        if not depth or len(y) < 8 or share in (0.0, 1.0):
            return (share,)
        best = (0.0, -1, 0.0)
        for f in rng.permutation(x.shape[1])[: max(2, int(np.sqrt(x.shape[1])) + 1)]:
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            left, n = cut + 1, len(y)
            p, q = s[cut] / left, (s[-1] - s[cut]) / (n - left)
            gain = share * (1 - share) - (left * p * (1 - p) + (n - left) * q * (1 - q)) / n
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] < 0:
            return (share,)
        low = x[:, best[1]] <= best[2]
        return (best[1], best[2], self.grow(x[low], y[low], depth - 1, rng), self.grow(x[~low], y[~low], depth - 1, rng))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(node: tuple, row: np.ndarray) -> float:
            while len(node) > 1:
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node[0]

        return np.array([np.mean([walk(t, row) for t in self.trees]) for row in x])

    def expression(self, row: Column) -> Column:
        """The forest as one SQL expression over a struct of features."""

        def walk(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(round(node[0], 6))
            return F.when(row[FEATURES[node[0]]] <= F.lit(node[1]), walk(node[2])).otherwise(walk(node[3]))

        total = walk(self.trees[0])
        for t in self.trees[1:]:
            total = total + walk(t)
        return F.round(total / len(self.trees), 6)


def learnt(findings: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """At most ``most`` of the findings, by a hash."""
    return findings.filter("label IN (0, 1)").orderBy(F.xxhash64("before", "value", "after", "path"), "value", "label").limit(most)


def matrix(kept: DataFrame, odds: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the findings, which ``learnt`` has bounded."""
    value, before = F.coalesce("value", F.lit("")), F.coalesce("before", F.lit(""))
    head = F.regexp_extract(before, rf"(?i)(?:{NAMES})[\"']?\s{{0,3}}[:=]{{1,2}}\s{{0,3}}[\"']?$", 0)
    side = F.substring(before, F.lit(1), F.length(before) - F.length(head))
    made = kept.select(features(value, F.concat(head, value), side, F.coalesce("after", F.lit("")), F.coalesce("path", F.lit("")), odds).alias("x"), F.col("label").cast("int").alias("y"))
    rows = made.select("x.*", "y").collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows]).reshape(-1, len(FEATURES))
    return x, np.array([r["y"] for r in rows], float)


def train(spark: SparkSession, findings: DataFrame | None = None) -> Forest:
    kept = learnt(findings if findings is not None else findings_frame(spark, default_findings()))
    odds = transition_odds(kept)
    return Forest(*matrix(kept, odds), odds)


def candidates(docs: DataFrame, forest: Forest, text_column: str = "text", path_column: str = "source") -> DataFrame:
    """``docs`` with __parts (the texts between the matches) and __found: match, value, head and tail (chars of the match beside the value), kind and score of each match."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_column).cast("string"), F.lit("")) if path_column in docs.columns else F.lit("")
    # only rows that could have a match are split; the first test is a plain scan
    cut = docs.withColumn("__matches", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    cut = cut.withColumn("__parts", F.when(F.size("__matches") > 0, F.split(text, PATTERN, -1)).otherwise(F.array(text)))
    zipped = F.arrays_zip(
        F.col("__matches").alias("match"),
        F.slice(F.col("__parts"), F.lit(1), F.size("__matches")).alias("before"),
        F.slice(F.col("__parts"), F.lit(2), F.size("__matches")).alias("after"),
    )
    cut = cut.withColumn("__zip", F.when(F.size("__matches") > 0, zipped))

    def piece(z: Column) -> Column:
        bare = F.regexp_replace(z["match"], HEAD, "")
        value = F.regexp_replace(bare, TAIL, "")
        return F.struct(
            z["match"].alias("match"),
            value.alias("value"),
            (F.length(z["match"]) - F.length(bare)).alias("head"),
            (F.length(bare) - F.length(value)).alias("tail"),
            z["before"].alias("before"),
            z["after"].alias("after"),
        )

    def scored(p: Column) -> Column:
        kind = F.when(p["value"].rlike("^AKIA[0-9A-Z]{16}$"), "access_key").when(p["head"] > 0, "assigned_secret").otherwise("random_string")
        return F.struct(
            p["match"].alias("match"),
            p["value"].alias("value"),
            p["head"].alias("head"),
            p["tail"].alias("tail"),
            kind.alias("kind"),
            forest.expression(p["x"]).alias("score"),
        )

    def described(p: Column, at: Column) -> Column:
        x = features(p["value"], p["match"], p["before"], p["after"], at, forest.odds)
        return F.struct(p["match"].alias("match"), p["value"].alias("value"), p["head"].alias("head"), p["tail"].alias("tail"), x.alias("x"))

    cut = cut.withColumn("__pieces", F.transform("__zip", piece)).withColumn("__described", F.transform("__pieces", lambda p: described(p, path)))
    return cut.withColumn("__found", F.transform("__described", scored)).drop("__matches", "__zip", "__pieces", "__described")


def scan(docs: DataFrame, forest: Forest, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source", least: float = 0.5) -> DataFrame:
    """A row per secret: doc_id, start, length, kind, secret, score."""
    found = candidates(docs, forest, text_column, path_column).filter(F.size("__found") > 0)
    sizes = F.transform(F.arrays_zip(F.col("__found.match").alias("m"), F.col("__parts").alias("p")), lambda z: F.coalesce(F.length(z["m"]), F.lit(0)) + F.length(z["p"]))
    rows = found.select(F.col(id_column).cast("long").alias("doc_id"), sizes.alias("__sizes"), F.transform("__parts", F.length).alias("__gaps"), F.posexplode("__found").alias("__at", "__one"))
    rows = rows.filter(F.col("__one.score") >= least)
    start = F.aggregate(F.slice(F.col("__sizes"), F.lit(1), F.col("__at")), F.lit(0).cast("long"), lambda s, x: s + x) + F.element_at("__gaps", F.col("__at") + 1) + F.col("__one.head")
    return rows.select("doc_id", start.alias("start"), F.length("__one.value").cast("long").alias("length"), F.col("__one.kind").alias("kind"), F.col("__one.value").alias("secret"), F.col("__one.score").alias("score"))


def redact(docs: DataFrame, forest: Forest, text_column: str = "text", path_column: str = "source", least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text_column`` replaced by ``mark``."""
    cut = candidates(docs, forest, text_column, path_column)

    def shown(f: Column) -> Column:
        changed = F.concat(F.substring(f["match"], F.lit(1), f["head"]), F.lit(mark), F.right(f["match"], f["tail"]))
        return F.when(f["score"] >= least, changed).otherwise(f["match"])

    pairs = F.arrays_zip(F.col("__parts").alias("p"), F.transform("__found", shown).alias("m"))
    again = F.array_join(F.transform(pairs, lambda z: F.concat(z["p"], F.coalesce(z["m"], F.lit("")))), "")
    text = F.when(F.col(text_column).isNull() | (F.size("__found") <= 0) | F.col("__found").isNull(), F.col(text_column)).otherwise(again)
    return cut.withColumn(text_column, text).select(*docs.columns)
