"""Secret scanning with a random forest for false-positive removal. [native]

Candidates are of two kinds: runs of ``LEAST`` or more characters of keys with a
digit or a capital after a small letter, dots between long runs included; and
values of ``SHORT`` or more characters of any kind that stand after a secret word
and a sign of assignment.  A forest judges each from its length, its
character classes and transitions (changes of class, pairs of letters that are
usual in prose), entropy, the share that dictionary words cover, its path and the
words beside it.  It is trained from labelled findings: rows of candidate,
before, after, path and label (1: a secret).  Where the user has none,
``example_findings`` makes some by rule from a fixed seed.

Candidates, features and scores are DataFrame expressions and a JVM-side model;
no Python runs on executors and nothing is shuffled.  A text's offsets are sums
over blocks of ``BLOCK`` pieces, so a text costs what its candidates cost.

Out of reach: keys under ``LEAST`` characters, or of one case without a digit,
with no secret word before them; values under ``SHORT`` characters.

Nulls and odd input.  Null and empty texts have no candidates; a null path is
an empty one.  A control character \\x01 in a text counts as a space.  Repeated
rows are scanned each.  Offsets are in characters of the text, from 0.  Extra
columns are ignored.  Labelled findings with nulls are left out of training;
with labels of one class only, every score is that class (0 or 1); without any
labelled finding there is no model, and every candidate is kept with score 0.5.
"""

from __future__ import annotations

import random
import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, SHORT, BLOCK = 16, 6, 256
TREES, DEPTH, SEED = 40, 8, 11
_WITH = r"[0-9]|[a-z][A-Z]"
_MARK = "\x01"

# Words that tell about a candidate's surroundings, known key
# prefixes, dictionary words and pairs of letters usual in prose.
SECRET_WORDS = "password passwd pwd passphrase secret token apikey api_key access auth credential credentials bearer private key login".split()
HARMLESS_WORDS = "example sample placeholder dummy checksum sha sha1 sha256 md5 digest commit revision uuid guid hash etag version build image id isbn serial order invoice tracking".split()
HARMLESS_PATHS = "test tests example examples sample doc docs mock fixture fixtures spec vendor lock".split()
PREFIXES = "AKIA ASIA AIza ghp_ gho_ ghs_ glpat- xoxb- xoxp- sk_live_ rk_live_ sk- npm_ hf_".split()
DICTIONARY = "example sample test placeholder your here insert change default config configuration setting value index table column field name user users account order item product version build release package module class method function object string number integer boolean array list map data file path image video audio page post title content header footer button label input output report summary detail request response server client service session cookie cache query filter search result total count date time year month day start end first last next previous message error warning info debug".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

_KEY = r"[A-Za-z0-9_+/\-]"
#: What introduces a value, the value (2), or a free-standing key (3).
CANDIDATE = (
    "((?i:" + "|".join(SECRET_WORDS) + r")[\"'\])]{0,2}[ \t]{0,3}(?:=>|:=|==|=|:)[ \t]{0,3}[\"'`]?)"
    + rf"([^\s\"'`<>,;]{{{SHORT},}})"
    + rf"|(?<!{_KEY})((?:{_KEY}{{10,}}\.){{0,2}}{_KEY}{{{LEAST},}}={{0,2}})(?!{_KEY})"
)

#: How the text before an introduced value ends.
INTRODUCED = "(?i:" + "|".join(SECRET_WORDS) + r")[\"'\])]{0,2}[ \t]{0,3}(?:=>|:=|==|=|:)[ \t]{0,3}[\"'`]?$"

FEATURES = ("length", "digits", "capitals", "changes", "pairs", "distinct", "entropy", "hex", "dictionary", "prefix", "assigned", "secret_word", "harmless_word", "harmless_path", "signs", "code", "quoted")


def _any_of(words: list[str]) -> str:
    return "(?<![a-z0-9])(" + "|".join(words) + ")(?![a-z0-9])"


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The features of a candidate, each a double."""
    low, n = F.lower(candidate), F.length(candidate).cast("double")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    chars = F.array_distinct(F.split(candidate, ""))
    share = lambda ch: (n - F.length(F.replace(candidate, ch, F.lit("")))) / n
    beside = F.lower(F.concat(before, F.lit(" "), after))
    return {
        "length": n,
        "digits": count(candidate, "[0-9]") / n,
        "capitals": count(candidate, "[A-Z]") / n,
        "changes": count(candidate, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]") / n,
        "pairs": count(low, "(?=" + "|".join(PAIRS) + ")") / n,
        "distinct": F.size(F.filter(chars, lambda c: c != "")) / n,
        "entropy": F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))),
        "hex": flag(F.regexp_like(low, F.lit("^[0-9a-f]+$"))),
        "dictionary": 1.0 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "prefix": flag(F.regexp_like(candidate, F.lit("^(" + "|".join(PREFIXES) + ")"))),
        "assigned": flag(F.regexp_like(before, F.lit("[=:]\\s*[\"']?$"))),
        "secret_word": flag(F.regexp_like(F.lower(before), F.lit("(" + "|".join(SECRET_WORDS) + ")[^a-z0-9]{0,6}$"))),
        "harmless_word": flag(F.regexp_like(beside, F.lit(_any_of(HARMLESS_WORDS)))),
        "harmless_path": flag(F.regexp_like(F.lower(path), F.lit(_any_of(HARMLESS_PATHS)))),
        "signs": count(candidate, "[^A-Za-z0-9]") / n,
        "code": flag(F.regexp_like(candidate, F.lit(r"[(){}\[\]]|\.[a-z]+\."))),
        "quoted": flag(F.regexp_like(before, F.lit("[\"'`]$"))),
    }


def candidates(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """doc_id, begin, candidate, before, after, path of every candidate; before
    and after are up to 40 characters beside it, on its line."""
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col in docs.columns else F.lit("")
    own = docs.select("doc_id", F.translate("text", _MARK, " ").alias("text"), path.alias("path"))
    # candidates stand at the odd places between marks; a text without any is one part
    parts = own.select("doc_id", "path", F.split(F.regexp_replace("text", CANDIDATE, f"$1{_MARK}$2$3{_MARK}"), _MARK, -1).alias("parts"))
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    parts = parts.withColumn("sizes", F.transform("parts", lambda p: F.length(p)))
    blocks = F.sequence(F.lit(0), F.floor(F.size("sizes") / BLOCK).cast("int"))
    parts = parts.withColumn("sums", F.transform(blocks, lambda b: total(F.slice("sizes", b * BLOCK + 1, F.lit(BLOCK)))))
    parts = parts.withColumn("upto", F.transform(blocks, lambda b: total(F.slice("sums", F.lit(1), b))))
    at = lambda k: F.floor((2 * k - 1) / BLOCK).cast("int")
    one = lambda k: F.struct(
        (F.element_at("upto", at(k) + 1) + total(F.slice("sizes", at(k) * BLOCK + 1, 2 * k - 1 - at(k) * BLOCK))).alias("begin"),
        F.element_at("parts", 2 * k).alias("candidate"),
        F.regexp_extract(F.right(F.element_at("parts", 2 * k - 1), F.lit(40)), r"[^\n]*$", 0).alias("before"),
        F.regexp_extract(F.left(F.element_at("parts", 2 * k + 1), F.lit(40)), r"^[^\n]*", 0).alias("after"),
    )
    n = F.floor(F.size("parts") / 2).cast("int")
    # explode_outer: for explode the optimizer would add a filter that makes every candidate once more
    each = parts.select("doc_id", "path", F.explode_outer(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), one))).alias("c")).where("c IS NOT NULL")
    given = F.regexp_like("before", F.lit(INTRODUCED))
    return each.select("doc_id", "c.*", "path").where(given | F.regexp_like("candidate", F.lit(_WITH)))


def _featured(rows: DataFrame) -> DataFrame:
    made = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    return VectorAssembler(inputCols=[f"_f_{c}" for c in FEATURES], outputCol="_features").transform(rows.select("*", *[made[c].alias(f"_f_{c}") for c in FEATURES]))


def train(findings: DataFrame) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (candidate, before, after, path, label);
    None without any."""
    rows = findings.where(F.col("label").isin(0, 1)).select("candidate", "before", "after", "path", F.col("label").cast("double")).dropna().where(F.length("candidate") > 0)
    if not rows.limit(1).count():
        return None
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(_featured(rows))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None, path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, begin, end, secret, score of the candidates that the forest keeps."""
    rows = candidates(docs, path_col)
    if model is None:
        scored, score = rows, F.lit(0.5)
    else:
        scored, score = model.transform(_featured(rows)), vector_to_array("_probability")
        # a model of one class only has that of label 0
        score = F.when(F.size(score) > 1, F.try_element_at(score, F.lit(2))).otherwise(0.0)
    found = scored.select("doc_id", "begin", (F.col("begin") + F.length("candidate")).alias("end"), F.col("candidate").alias("secret"), score.alias("score"))
    return found.where(F.col("score") >= threshold)


def example_findings(spark: SparkSession, n: int = 6000, seed: int = 5) -> DataFrame:
    """n labelled findings by rule: half secrets (keys, tokens and passwords of
    several forms, short and with signs too, in telling places), half look-alikes
    (digests, ids, long names, words and code after a secret word, placeholders)."""
    rng, rows = random.Random(seed), []
    pick = lambda pool, k: "".join(rng.choice(pool) for _ in range(k))
    prose = lambda k: " ".join("".join(rng.choice(PAIRS) for _ in range(rng.randint(1, 5))) for _ in range(k))
    hexa, key, small = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_lowercase
    given = lambda: f"{rng.choice(SECRET_WORDS)}{rng.choice(['=', ' = ', ': ', ':', ' := ', ' => '])}{rng.choice(['', chr(34), chr(39)])}"
    for k in range(n):
        secret = k % 2 == 0
        form, lead, path = rng.random(), prose(rng.randint(0, 4)), f"src{rng.randint(0, 99)}"
        if secret:
            if form < 0.12:  # passwords: short, often with signs
                own, before = pick(key + "!@#$%&*.?^-_", rng.randint(7, 15)), f"{lead} {given()}"
            elif form < 0.18:  # a word or two with figures or signs
                own, before = "".join(rng.choice([w, w.capitalize()]) for w in (rng.choice(DICTIONARY) for _ in range(rng.randint(1, 2)))) + pick(string.digits + "!@#$", rng.randint(2, 4)), f"{lead} {given()}"
            elif form < 0.24:  # one case, no figure
                own, before = pick(small, rng.randint(16, 32)), f"{lead} {given()}"
            elif form < 0.3:  # parts between dots
                own, before = ".".join(pick(key + "_-", rng.randint(12, 40)) for _ in range(3)), f"{lead} {given() if rng.random() < 0.6 else ''}"
            elif form < 0.5:
                prefix = rng.choice(PREFIXES)
                own = prefix + (pick(string.ascii_uppercase + string.digits, 16) if prefix in ("AKIA", "ASIA") else pick(key, rng.randint(20, 40)))
                before = f"{lead} " if rng.random() < 0.7 else f"{lead} {rng.choice(SECRET_WORDS)}={''}"
            else:
                own = pick(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64])) if form < 0.75 else pick(key + "+/_-", rng.randint(16, 48))
                before = f"{lead} {rng.choice(SECRET_WORDS)}{rng.choice(['=', ' = ', ': ', ' '])}{rng.choice(['', chr(34)])}"
        elif form < 0.15:  # words and code where a value could stand
            words = [rng.choice(DICTIONARY) for _ in range(rng.randint(1, 3))]
            own = rng.choice(["".join(rng.choice(PAIRS) for _ in range(rng.randint(3, 6))), "_".join(words).ljust(SHORT, "s"), f"{words[0]}({words[-1]})", f"os.{words[0]}[{words[-1]}]", f"${{{'_'.join(words).upper()}}}", "self." + "_".join(words), "".join(rng.choice(PAIRS) for _ in range(4)) + "."])
            before = f"{lead} {given()}"
        elif form < 0.35:
            own, before = pick(hexa, rng.choice([32, 40, 64])), f"{lead} {rng.choice(HARMLESS_WORDS)}{rng.choice([' ', ': ', '=', ' = '])}"
        elif form < 0.5:
            own, before = pick(string.digits, rng.randint(16, 22)), f"{lead} "
        elif form < 0.75:
            words = [rng.choice(DICTIONARY) for _ in range(rng.randint(2, 5))]
            own = rng.choice(["_".join(words) + pick(string.digits, 2), "".join(w.capitalize() for w in words), "-".join([*words, pick(string.digits, 1)]), "/".join([*words, "v2"])])
            own, before = own.ljust(LEAST, "x"), f"{lead} {rng.choice([*SECRET_WORDS, ''])}{rng.choice(['=', ' ', ': '])}"
        elif form < 0.9:
            own, before = "".join(rng.choice(PAIRS) for _ in range(rng.randint(7, 14))).capitalize() + pick(string.digits, 2) + "xy", f"{lead} "
        else:
            own, before = rng.choice(["your_api_key_here_123", "changeMe1234567890", "xxxxxxxxxxxxxxxx0000", "example_token_0000000"]), f"{lead} {rng.choice(SECRET_WORDS)}="
            path = rng.choice(HARMLESS_PATHS)
        rows.append((own, before[-40:], prose(rng.randint(0, 3))[:40], path, int(secret)))
    return spark.createDataFrame(rows, "candidate string, before string, after string, path string, label int").coalesce(1).repartition(4, "candidate")
