"""Secret scans: candidates by pattern, false positives removed by a random forest trained on labelled findings.

Candidates are long runs of key characters in the words of a text, and every value that is assigned to a
credential's name or follows it, whatever its length and characters: the word and what a sign of separation
leaves of it, and what stands in quotes, over several words (put together by single blanks) if need be. Features are numbers of the run itself
(length, character classes and their transitions, letter pairs of plain language, dictionary coverage, path
marks) and of the words around it. Spark ML trains the forest on at most `TRAINING_ROWS` labelled findings,
taken by hash; everything else covers all rows. Only DataFrame functions and Spark ML are used.

Labels of reviewers train a forest over all features. Distant labels come in part from the context: so their
forest reads only what `FORM` has, not the names and signs around a value, and keys without a name are judged
by their form. Bare keys of unknown form have no distant label; those of a known form (`KNOWN`) are secrets.

Texts are read once; candidates, a small part of them, are written to the shared folder.

Defined results: null and empty texts have no candidates. Repeated rows have findings of their own. If the
labelled findings lack one of the two classes, there is no forest; candidates that distant labels call none
have score 0 and all others 1, bare keys of unknown form among them. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import let, store, text_or_empty

RUN = r"[A-Za-z0-9+/_.\-]{16,}={0,2}"
TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 24, 6, 10
THRESHOLD = 0.5

# Word lists of the features; parameters of this scan.
CREDENTIAL = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key")
BENIGN = ("example", "sample", "test", "dummy", "checksum", "sha1", "sha256", "md5", "commit", "hash", "uuid", "version", "isbn", "phone", "card")
DICTIONARY = (
    "account", "address", "admin", "application", "array", "backup", "build", "cache", "class", "client", "cloud", "code", "com", "config", "content", "data", "default",
    "demo", "description", "doc", "domain", "email", "error", "event", "example", "file", "function", "group", "header", "home", "html", "http", "https", "image", "index",
    "info", "input", "internal", "item", "java", "json", "lang", "library", "license", "line", "link", "list", "local", "mail", "main", "message", "method", "model", "module",
    "name", "net", "node", "number", "object", "org", "output", "package", "page", "path", "placeholder", "policy", "product", "project", "public", "query", "release",
    "request", "resource", "response", "sample", "schema", "script", "server", "service", "session", "source", "static", "string", "style", "system", "table", "template", "test",
    "text", "title", "type", "update", "upload", "user", "util", "value", "version", "video", "view", "web", "window", "word", "www", "xml", "xxxx", "your",
)
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ch", "de", "le", "qu", "ou", "ie", "ge", "ue", "ci")

# Whole words only: `latest` and `discard` say nothing.
_BENIGN = r"(?<![a-z0-9])(?:" + "|".join(BENIGN) + r")(?:e?s)?(?![a-z0-9])"
KNOWN = (
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}"
    r"|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]+)[.]?$"
)
# Of values beside a credential's name. A name may be part of a longer one.
_NAME = "(?i)(?:" + "|".join(CREDENTIAL) + r""")[A-Za-z0-9_.\-]*["'`\])]*"""
NAME_BEFORE, ASSIGNED_HERE = _NAME + r"""[=:]*>?["'`]*$""", _NAME + r"[=:]+>?(.+)"
ASSIGNED_PART = _NAME + r"""[=:]+>?(["'`][^"'`]+|[^"'`,;&]+)"""
BETWEEN = r"(?i)^(?:[=:>\-]+|is|was)$"
OPENING, PHRASE = r"""^[=:>]*["'`][^"'`]*$""", r"""^[=:>]*(["'`])(.*?)\1"""
EDGES = r"""^[=:>]*["'`(\[{<]*|["'`)\]}>,;]+$"""

FEATURES = (
    "length", "digits", "uppers", "hexes", "vowels", "distinct", "changes", "pairs", "coverage", "slashes", "dots", "dashes", "numeric",
    "named", "benign", "assigned", "quoted", "alone",
)
FORM = tuple(x for x in FEATURES if x not in ("named", "assigned", "quoted", "alone"))


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, word (its number in the text), part, value, before (three words and what precedes the value in its own), after."""
    words = F.filter(F.split(text_or_empty(), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    at = lambda all_words, i: F.coalesce(F.get(all_words, i), F.lit(""))

    def picked(all_words: Column) -> Column:
        def near(w: Column, i: Column) -> Column:
            before = at(all_words, i - 1)
            follows = (before.rlike(NAME_BEFORE) | (before.rlike(BETWEEN) & at(all_words, i - 2).rlike(NAME_BEFORE))) & ~w.rlike(BETWEEN)
            here = w.rlike(ASSIGNED_HERE)
            runs = (F.length(w) >= 16) & w.rlike(RUN)
            # What follows a name may be quoted up to a later word.
            opened = (follows & w.rlike(OPENING)) | (here & F.regexp_extract(w, ASSIGNED_HERE, 1).rlike(OPENING))
            rest = F.when(opened, F.array_join(F.slice(all_words, i + 1, F.size(all_words)), " "))
            left = F.concat_ws(" ", at(all_words, i - 3), at(all_words, i - 2), before)
            return F.when(runs | follows | here, F.struct(i.alias("word"), w.alias("own"), left.alias("left"), follows.alias("follows"), here.alias("here"), rest.alias("rest")))

        return F.filter(F.transform(all_words, near), lambda x: x.isNotNull())

    def plain(raw: Column) -> Column:
        """A value without its quotes: up to the closing one, or without signs at its edges."""
        return F.array(F.regexp_extract(raw, PHRASE, 2), F.regexp_replace(raw, EDGES, ""))

    none = F.array().cast("array<string>")
    found = documents.select("doc_id", F.explode(let(words, picked)).alias("w")).select("doc_id", "w.*")
    here, rest = F.regexp_extract("own", ASSIGNED_HERE, 1), F.coalesce("rest", F.lit(""))
    phrase = F.when(F.col("here"), F.regexp_extract(F.regexp_extract(rest, ASSIGNED_HERE, 1), PHRASE, 2)).otherwise(F.regexp_extract(rest, PHRASE, 2))
    parts = F.flatten(F.transform(F.regexp_extract_all("own", F.lit(ASSIGNED_PART), F.lit(1)), plain))
    named = F.concat(F.when(F.col("follows"), plain(F.col("own"))).otherwise(none), F.when(F.col("here"), F.concat(plain(here), parts)).otherwise(none), F.array(phrase))
    # An explode of its own keeps the parts of a word from being searched again for each column.
    told = found.withColumn("runs", F.regexp_extract_all("own", F.lit(f"({RUN})"), F.lit(1))).withColumn("named", F.filter(F.array_distinct(named), lambda v: v != ""))
    values = F.concat("runs", F.array_except("named", "runs"))
    runs = told.select("doc_id", "word", "own", "left", "rest", "named", F.posexplode(values).alias("part", "value"))
    # Quoted phrases are longer than their word.
    held = F.when(F.instr("own", F.col("value")) > 0, F.col("own")).otherwise(F.coalesce("rest", "own"))
    placed = runs.withColumn("own", held)
    kept = placed.withColumn("before", F.concat_ws(" ", "left", F.expr("substring(own, 1, instr(own, value) - 1)"))).withColumn(
        "after", F.expr("substring(own, instr(own, value) + length(value))"),
    )
    odd = F.col("value").rlike("[0-9]") | F.col("value").rlike("[a-z][A-Z]") | F.col("before").rlike("[=:]\\s*[\"']?$") | F.array_contains("named", F.col("value"))
    return kept.filter(odd).select("doc_id", "word", "part", "value", "before", "after")


def with_features(found: DataFrame) -> DataFrame:
    value, size = F.col("value"), F.length("value")
    share = lambda pattern: (size - F.length(F.regexp_replace(value, pattern, ""))) / size
    mark = lambda words, text: F.lower(text).rlike("|".join(words)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "$1"))
    columns = {
        "length": size.cast("double"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "hexes": share("[0-9a-fA-F]"), "vowels": share("[aeiouAEIOU]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size, "changes": (runs - 1) / size,
        "pairs": F.regexp_count(F.lower(value), F.lit("|".join(PAIRS))) / size, "coverage": 1 - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / size,
        "slashes": share("/"), "dots": share("[.]"), "dashes": share("[-_]"), "numeric": value.rlike("^[0-9.\\-]+$").cast("double"),
        "named": mark(CREDENTIAL, F.col("before")), "benign": F.lower("before").rlike(_BENIGN).cast("double"), "assigned": F.col("before").rlike("[=:]\\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"), "alone": (F.col("before").rlike("(^|\\s)$") & (F.col("after") == "")).cast("double"),
    }
    return found.select("*", *(c.cast("double").alias(name) for name, c in columns.items()))


def _known() -> Column:
    return F.col("value").rlike(KNOWN) & (F.col("benign") == 0)


def _sure() -> Column:
    return _known() | ((F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("coverage") < 0.3) & (F.col("benign") == 0))


def _keylike() -> Column:
    """Letters and digits in no order that words, paths, addresses and numbers have."""
    form = F.col("value").rlike("^[A-Za-z0-9+/_\\-]+={0,2}[.]?$") & F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]")
    return form & (F.col("length") >= 16) & (F.col("coverage") < 0.3) & (F.col("changes") >= 0.2)


def _none() -> Column:
    """Benign by the words before, if no name claims the value; or no name, no assignment and no form of a key."""
    claimed = (F.col("named") == 1) & (F.col("assigned") == 1)
    bare = (F.col("named") == 0) & (F.col("assigned") == 0)
    return ~_known() & (((F.col("benign") == 1) & ~claimed) | (bare & ~_keylike()) | _prose())


def _prose() -> Column:
    """A short plain word that follows a name without a sign of assignment."""
    return (F.col("assigned") == 0) & (F.col("length") < 16) & F.col("value").rlike("^[A-Za-z]?[a-z']*[.,;:!?]*$")


def distant_labels(featured: DataFrame) -> DataFrame:
    """Labels where no reviewer's are at hand: 1 for values assigned to a credential's name or of a known form, 0 where
    nothing of this holds; others, keys without a name and values claimed by a name beside a benign word among them, have none."""
    return featured.withColumn("label", F.when(_sure(), 1.0).when(_none(), 0.0)).filter("label IS NOT NULL")


def train(labelled: DataFrame, rows: int = TRAINING_ROWS, features: tuple[str, ...] = FEATURES):
    """A forest from labelled findings (features and label), or None if one class is missing."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    order = F.xxhash64("value", "before", F.lit(SEED))
    # Each class gives at most half of the rows, so that rare secrets are not drowned.
    parts = [labelled.filter(F.col("label") == c).select(*FEATURES, "label").orderBy(order, *FEATURES).limit(rows // 2) for c in (0.0, 1.0)]
    sample = store(parts[0].union(parts[1]), "labelled-findings")
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2).fit(vectors)


def score(featured: DataFrame, forest, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """`featured` and the forest's score."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if forest is None:
        return featured.withColumn("score", F.when(_none(), 0.0).otherwise(1.0))
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(featured)
    scored = forest.transform(vectors)
    return scored.withColumn("score", F.round(vector_to_array("probability")[1], 6)).select(*featured.columns, "score")


def scan(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of `documents` with score and secret (whether the forest keeps it).

    labelled: findings (value, before, after, label) that reviewers have judged; without them, labels come
    from the candidates themselves by `distant_labels`.
    """
    found = store(with_features(candidates(documents)), "secret-candidates")
    if labelled is not None:
        scored = score(found, train(with_features(labelled)))
    else:
        scored = score(found, train(distant_labels(found), features=FORM), FORM)
        scored = scored.withColumn("score", F.when(_known(), 1.0).otherwise(F.col("score")))
    return scored.withColumn("secret", F.col("score") >= THRESHOLD)


def scan_digest(documents: DataFrame) -> DataFrame:
    """doc_id, word, part, length, value_sha256, score, secret of every candidate; values themselves are not given out."""
    return scan(documents).select(
        "doc_id", "word", "part", F.col("length").cast("int").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "secret",
    )
