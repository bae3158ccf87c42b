"""Secrets in texts: candidates by pattern, false positives removed by a random forest, with DataFrame operations only.

Candidates are whole private keys (from the BEGIN line to the END line, or to the last line of key characters), passwords
in addresses (scheme://user:password@host), whole JSON web tokens, runs of 16 or more token characters that hold a digit or
a capital after the first one, with their padding, and what a name like "password" is given: 6 or more characters of any
kind, in quotes also with blanks. The forest sees their length, character classes and transitions, dictionary coverage, path
shape and neighbouring words; it is trained from labelled findings (`synthetic_findings` makes a fixed set of them, by
kinds).

find_secrets gives one row per candidate: the id, `start` and `end` in code points (end exclusive), its probability and
the verdict. Null and empty texts have no candidates; rows that repeat an id, or have none, are told apart by `row`; extra
columns are not read. redact replaces the secrets and keeps every row, also those without an id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

_TOKEN = "[A-Za-z0-9+/_-]"
# Names that are given secrets, not the words that only begin like them (author, secretary, tokenizer).
_NAMES = "secrets?(?![a-z])|secret[_-]?key|tokens?(?![a-z])|passw|passphrase|pwd(?![a-z])|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?(?![a-z])|auth(?![a-z])|bearer(?![a-z])"
# A name is looked for where one may begin; what stands before it in its word is no part of the match.
_NAMED = rf"(?=[stpacbSTPACB])(?i:{_NAMES})[A-Za-z0-9_]{{0,16}}+[\"']?\s{{0,3}}+(?::=|=>|[:=])\s{{0,3}}+"
# A name and what stands between it and its value.
ASSIGNED = rf"{_NAMED}[\"'`]?"
# A run of token characters that ends in the name of what is assigned is no candidate itself.
_NO_NAME = rf"(?!{_TOKEN}*(?i:{_NAMES})[A-Za-z0-9_]{{0,16}}[\"']?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}[\"'`]?[^\s\"'`<>]{{6}})"
CANDIDATE = "|".join(
    (
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----|[A-Za-z0-9+/=\s]*+)",
        # A colon first: what looks back over an address is tried nowhere else.
        r"(?<=:)(?!//)(?<=://[^\s:/@\"'<>]{0,64}:)[^\s/@\"'<>]{4,200}(?=@)",
        rf"{_NAMED}(?:[\"'`](?!-----BEGIN)[^\"'`<>\n]{{6,200}}(?=[\"'`])|[\"'`]?(?!-----BEGIN)[^\s\"'`<>]{{5,}}[^\s\"'`<>.,;:!?)\]}}])",
        r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,})?",
        rf"(?<!{_TOKEN})(?={_TOKEN}[a-z+/_-]*+[A-Z0-9]){_NO_NAME}{_TOKEN}{{16,}}+={{0,2}}+",
    )
)
CONTEXT = 64

# Words that make a candidate readable, words before a secret, and words before what only looks like one.
DICTIONARY = (
    "access admin alpha android apple application archive article asset backup banner beta book branch browser build button cache camera center change "
    "class client cloud code color common component config content control count country course data date default delete design detail device direct "
    "document download driver element email engine error event example export feature field file filter final folder format frame function gallery game "
    "general global green group guide handle header height help home html icon image import index info input item java label language large latest layer "
    "layout left level library light line link linux list load local login logo main manager map master media member menu message method mobile model module "
    "month name network news number object office online option order output package page panel parent parser part path picture place player plugin point "
    "policy position post preview price print private process product profile program project public query random react read record red release remote "
    "report request resource response result review right root sample script search section select server service session setting share simple site size "
    "small source space special stable standard start state static status store story stream string style summer super support switch system table target "
    "team template test text theme thread time title tools topic track travel type update upload user utils value version video view visual web widget "
    "width window winter word work world your here changeme placeholder dummy insert replace todo none null true false key token secret password"
).split()
BEFORE_SECRET = "secrets?|tokens?|passw(?:or)?d|passwd|passphrase|pwd|api[_ -]?key|apikey|access[_ -]?key|auth|authorization|bearer|credentials?|private[_ -]?key|client[_ -]?secret|signing"
# Small words of sentences, which passphrases lack.
SMALL_WORDS = "a|an|and|are|as|at|be|by|can|for|from|has|if|in|is|it|must|no|not|of|on|or|our|should|that|the|their|this|to|was|we|will|with|you|your"
BEFORE_OTHER = "sha-?\\d*|md5|crc\\d*|commit|checksum|digest|hash|uuid|guid|etag|revision|integrity|build|blob|tree|object|session id|order|invoice|isbn|serial|card|account|version|phone"
PREFIXES = "AKIA[0-9A-Z]|ASIA[0-9A-Z]|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ[A-Za-z0-9]|SG\\.|ya29|-----BEGIN"


def _features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    """The forest's inputs, as expressions of built-in functions."""
    length = F.length(value)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern))
    share = lambda pattern: count(pattern) / length
    lowered = F.lower(value)
    uncovered = F.length(F.regexp_replace(lowered, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    letters = F.regexp_replace(lowered, "[^a-z]", "")
    common = F.regexp_count(letters, F.lit("(?=th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur)"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": length.cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share("[+/_=-]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / length,
        "class_changes": share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "common_pairs": common / F.greatest(F.length(letters) - 1, F.lit(1)),
        "covered": 1 - uncovered / length,
        "repeats": share(r"(.)(?=\1)"),
        "hex": flag(value.rlike("^[0-9a-fA-F]+$")),
        "all_digits": flag(value.rlike("^[0-9-]+$")),
        "uuid": flag(value.rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")),
        "prefix": flag(value.rlike(f"^(?:{PREFIXES})")),
        "others": share(r"[^A-Za-z0-9+/_=\s-]"),
        "blanks": share(r"\s"),
        "small_words": F.regexp_count(value, F.lit(rf"(?i)\b(?:{SMALL_WORDS})\b")) / F.greatest(count(r"\S+"), F.lit(1)),
        "sized_digest": flag(before.rlike(r"(?i)sha-?\d*[-:]?$") | value.rlike("(?i)^sha\\d{1,3}-")),
        "in_address": flag(before.rlike("://[^\\s:/@]*:$") & after.rlike("^@")),
        "data": flag(before.rlike(r"(?i)base64,?\s?$")),
        "slashes": count("/").cast("double"),
        "path": flag(before.rlike(r"(?:[\\/]|\.|://\S*)$") | after.rlike(r"^(?:\.[a-z]{2,4}\b|[\\/])")),
        "assigned": flag(before.rlike(r"[:=]\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "secret_word": flag(before.rlike(rf"(?i)(?:{BEFORE_SECRET})[\"']?\W{{0,6}}(?:is\W+)?$")),
        "other_word": flag(before.rlike(rf"(?i)\b(?:{BEFORE_OTHER})[\"']?\W{{0,6}}(?:is\W+)?(?:sha\d+-)?$")),
    }


FEATURES = (
    "length", "digits", "upper", "lower", "marks", "distinct", "class_changes", "common_pairs", "covered", "repeats", "hex", "all_digits", "uuid", "prefix", "others",
    "blanks", "small_words", "sized_digest", "in_address", "data", "slashes", "path", "assigned", "quoted", "secret_word", "other_word",
)


def with_features(findings: DataFrame) -> DataFrame:
    """findings(value, before, after, ...) with the column `features`."""
    made = findings.withColumns({f"f_{k}": c.cast("double") for k, c in _features(F.col("value"), F.col("before"), F.col("after")).items()})
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(made).drop(*[f"f_{k}" for k in FEATURES])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, start, end, value, before, after) of every candidate in the whole texts."""
    return _candidates(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))


def _candidates(rows: DataFrame) -> DataFrame:
    """candidates() of rows(row, id, text)."""
    hit = rows.where(F.col("text").rlike(CANDIDATE))
    cut_up = hit.select("row", "id", F.split("text", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    trimmed = F.transform("gaps", lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before"), F.left(g, F.lit(CONTEXT)).alias("after")))
    whole = cut_up.select("row", "id", "found", trimmed.alias("gaps"))
    lined = whole.select("row", "id", F.posexplode(F.arrays_zip(F.col("found").alias("found"), F.slice("gaps", F.lit(1), F.size("found")).alias("left"), F.slice("gaps", F.lit(2), F.size("found")).alias("right"))).alias("k", "c"))
    line = Window.partitionBy("row").orderBy("k")
    spans = lined.select("row", "id", "k", "c.found", F.col("c.left.before").alias("before"), F.col("c.right.after").alias("after"), F.col("c.left.gap").alias("gap"), F.length("c.found").alias("size"), F.regexp_extract("c.found", f"^{ASSIGNED}", 0).alias("name"))
    end = F.sum(F.col("gap") + F.col("size")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    # The name of an assigned value is no part of it, but of what stands before it.
    skip = F.when(F.col("size") - F.length("name") >= 6, F.length("name")).otherwise(0)
    placed = spans.withColumns({"end": end, "skip": skip})
    before = F.right(F.concat(F.coalesce("before", F.lit("")), F.substring("found", F.lit(1), F.col("skip"))), F.lit(CONTEXT))
    value = F.substring("found", F.col("skip") + 1, F.col("size"))
    return placed.select("row", "id", (F.col("end") - F.col("size") + F.col("skip")).alias("start"), "end", value.alias("value"), before.alias("before"), F.coalesce("after", F.lit("")).alias("after"))


def synthetic_findings(spark: SparkSession, n: int = 8800, without: tuple[str, ...] = ()) -> DataFrame:
    """A fixed set of n labelled findings (value, before, after, label, kind), as many of each kind, made by rule from hashes
    of row numbers. Kinds are made each by a projection of its own, so that none outgrows the compiler."""
    i = F.col("id")
    hexes = F.concat(F.sha1(F.concat(F.lit("a"), i).cast("binary")), F.sha1(F.concat(F.lit("b"), i).cast("binary")))
    packed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("c"), i).cast("binary"), 512))), r"\s|=", "")
    alnum = F.regexp_replace(packed, "[+/]", "x")
    draw = lambda salt, most: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(most)).cast("int")
    # A constant that folds to one array: options written out one by one make the code of a projection long.
    pick = lambda salt, *options: F.element_at(F.split(F.lit("\x1f".join(options)), "\x1f"), draw(salt, len(options)) + 1)
    word = lambda salt: pick(salt, *DICTIONARY[::3])
    size = draw("size", 45) + 18
    filler = F.concat_ws(" ", word("f1"), word("f2"), word("f3"))
    key = F.concat(filler, F.lit(" "), pick("key", "token", "secret", "api_key", "apiKey", "password", "access_key", "auth_token", "client_secret", "Bearer", "API key", "private_key", "passwd"), pick("op", " = ", ": ", "=", " is ", " := ", "\": ", " "))
    quote = pick("quote", '"', '"', "'", "")
    plain = F.concat(filler, pick("gap", " ", ", ", ": ", " ("))
    other = F.concat(filler, F.lit(" "), pick("other", "sha256", "sha1", "md5", "commit", "checksum", "digest", "uuid", "etag", "revision", "integrity", "object", "blob"), pick("op2", ": ", " = ", "=", " ", ":"))
    dashed = F.regexp_replace(F.substring(hexes, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    named = F.concat_ws("_", word("w1"), word("w2"), word("w3"), F.concat(F.lit("v"), draw("v", 90).cast("string")))
    holder = F.concat(pick("h", "your_", "my_", "insert_", "example_", "test_", "dummy_"), word("w1"), F.lit("_"), pick("h2", "token", "key", "secret", "password"), F.lit("_here_"), draw("v", 1000).cast("string"))
    slug = F.concat_ws("/", word("w1"), word("w2"), F.concat(word("w3"), draw("v", 2000).cast("string")), word("w4"))
    figures = F.rpad(F.substring(F.regexp_replace(hexes, "[a-f]", ""), 1, 19), 16, "7")
    repeated = F.concat(F.repeat(F.substring(hexes, 1, 2), 10), F.lit("0"))
    symbol = pick("sym", "!", "@", "#", "$", "%", "&", "*", "?", "^", "~")
    pem = pick("pem", "PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY")
    hex_size = F.element_at(F.array(*[F.lit(x) for x in (32, 40, 40, 64)]), draw("hs", 4) + 1)
    url = F.concat(filler, F.lit(" "), pick("scheme", "https", "http", "postgres", "mysql", "redis", "amqp", "ftp"), F.lit("://"), word("w1"), F.lit(":"))
    spoken = lambda at, salt: F.when(draw(salt, 3) == 0, word(salt)).otherwise(F.translate(F.substring(hexes, F.lit(at), draw(salt + "n", 5) + 4), "0123456789abcdef", "aeioustrnlmdbchy"))
    phrase = F.concat_ws(" ", spoken(1, "p1"), spoken(11, "p2"), spoken(21, "p3"), F.when(draw("four", 2) == 0, spoken(31, "p4")))
    small = lambda salt: pick(salt, "the", "your", "a", "must be", "is", "of the", "to", "for", "not")
    sentence = F.concat_ws(" ", small("s1"), word("w1"), small("s2"), word("w2"), F.when(draw("four", 2) == 0, small("s3")))
    web = F.concat(F.lit("eyJhbGciOi"), F.substring(alnum, 1, 20), F.lit(".eyJ"), F.substring(alnum, 5, 40), F.lit("."), F.substring(alnum, 20, 43))
    name = F.concat(F.initcap(spoken(1, "p1")), F.initcap(spoken(11, "p2")), F.initcap(spoken(21, "p3")))
    kinds = {
        "hex_key": (F.substring(hexes, F.lit(1), hex_size), F.concat(key, quote), quote, 1),
        "packed_key": (F.substring(packed, F.lit(1), size), F.concat(key, quote), quote, 1),
        "alnum_key": (F.substring(alnum, F.lit(1), size), F.concat(key, quote), quote, 1),
        "prefixed_key": (F.concat(pick("p", "AKIA", "ghp_", "xoxb-", "sk_live_", "AIza", "glpat-"), F.substring(alnum, 1, 36)), plain, F.lit(" "), 1),
        "web_token_named": (F.concat(F.lit("eyJhbGciOi"), F.substring(alnum, 1, 60)), F.concat(key, quote), quote, 1),
        "digest": (F.substring(hexes, F.lit(1), hex_size), F.concat(other, quote), quote, 0),
        "hex_alone": (F.substring(hexes, F.lit(1), hex_size), plain, F.lit(" "), 0),
        "uuid": (dashed, F.concat(pick("u", "", "id ", "request id: "), plain), F.lit(" "), 0),
        "snake_name": (named, F.concat(F.when(draw("ctx", 2) == 0, key).otherwise(plain), quote), quote, 0),
        "placeholder": (holder, F.concat(key, quote), quote, 0),
        "slug": (slug, F.concat(plain, pick("root", "/", "https://", "./", "www.x.org/")), pick("ext", ".png", ".html", "/", " "), 0),
        "figures": (figures, F.when(draw("ctx", 4) == 0, key).otherwise(plain), pick("after", " ", ".", ","), 0),
        "repeated": (repeated, F.concat(key, quote), quote, 0),
        "thrice": (F.concat(F.repeat(word("w1"), 3), draw("v", 99).cast("string")), F.concat(F.when(draw("ctx", 2) == 0, key).otherwise(plain), quote), quote, 0),
        "password_marks": (F.concat(F.substring(alnum, F.lit(1), draw("pw", 6) + 4), symbol, F.substring(packed, F.lit(20), draw("pw2", 8) + 4), symbol), F.concat(key, quote), quote, 1),
        "password_word": (F.concat(F.initcap(word("w1")), symbol, draw("pv", 9000).cast("string"), F.substring(alnum, 1, 3)), F.concat(key, quote), quote, 1),
        "private_key": (F.concat(F.lit("-----BEGIN "), pem, F.lit("-----\n"), F.repeat(F.concat(packed, F.lit("\n")), 3), F.lit("-----END "), pem, F.lit("-----")), F.concat(plain, F.lit("\n")), F.lit("\n"), 1),
        "two_words": (F.concat(word("w1"), pick("join", "", ".", "-", "_", "/"), word("w2")), F.concat(key, quote), quote, 0),
        "call": (F.concat(pick("get", "get", "os.", "self.", "config.", "$", "${"), F.initcap(word("w1")), pick("call", "(", "_", "."), F.upper(word("w2"))), F.concat(key, quote), quote, 0),
        "camel_name": (F.concat(word("w1"), F.initcap(word("w2")), F.initcap(word("w3")), F.initcap(word("w4"))), F.concat(F.when(draw("ctx", 2) == 0, key).otherwise(plain), quote), quote, 0),
        "constant": (F.concat(F.upper(word("w1")), F.lit("_"), F.upper(word("w2")), F.lit("_"), F.upper(word("w3"))), F.concat(plain, quote), pick("eq", "=", " = ", ": ", " "), 0),
        "address": (F.concat(F.lit("https://"), word("w1"), F.lit("."), word("w2"), F.lit("/"), word("w3")), F.concat(key, quote), quote, 0),
        "address_password": (F.concat(F.substring(alnum, F.lit(1), draw("pw", 14) + 6), F.when(draw("m", 2) == 0, F.lit("!")).otherwise("")), url, F.concat(F.lit("@"), word("w2"), F.lit("."), word("w3")), 1),
        "address_word": (F.concat(word("w1"), draw("pv", 9000).cast("string"), word("w4")), url, F.concat(F.lit("@"), word("w2")), 1),
        "web_token": (web, plain, pick("after", " ", ".", ",", "\n"), 1),
        "phrase": (phrase, F.concat(key, F.lit('"')), F.lit('"'), 1),
        "short_password": (F.concat(word("w1"), draw("pv", 99).cast("string")), F.concat(key, quote), quote, 1),
        "sentence": (sentence, F.concat(key, F.lit('"')), F.lit('"'), 0),
        "word": (spoken(1, "p1"), F.concat(key, quote), quote, 0),
        "integrity": (F.concat(pick("sha", "sha256-", "sha384-", "sha512-"), F.substring(packed, F.lit(1), draw("is", 22) + 42), pick("pad", "", "=", "==")), F.concat(filler, pick("int", ' integrity="', " integrity: ", " hash=", " digest: ", ' "integrity": "')), pick("intq", '"', " ", '"'), 0),
        "data": (F.concat(F.substring(packed, F.lit(1), size), F.substring(packed, F.lit(2), size)), F.concat(filler, pick("mime", " data:image/png;base64,", " data:font/woff;base64,", " src=data:image/gif;base64,")), pick("dataq", '"', ")", " "), 0),
        "person": (name, F.concat(plain, pick("who", "author: ", "author=", "secretary: ", "tokenizer: ", "authority = ", "by: ", "name: ", "class: ", "class ", "import ")), pick("after", " ", ".", ",", "("), 0),
    }
    rows = spark.range(0, n // len(kinds), 1, 1)
    made = [rows.select(v.alias("value"), b.alias("before"), a.alias("after"), F.lit(float(y)).alias("label"), F.lit(kind).alias("kind")) for kind, (v, b, a, y) in kinds.items() if kind not in without]
    return reduce(DataFrame.union, made)


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, before, after, label). They are written before their features are, so that these
    are one projection however findings are put together, and features are written once, since a fit reads them often."""
    ready = cut(with_features(cut(findings, "labelled")).select("features", "label"), "findings")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=3).fit(ready)


def find_secrets(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(row, id_col, start, end, value, probability, is_secret) of every candidate."""
    return _judged(candidates(docs, id_col, text_col), model, threshold).withColumnRenamed("id", id_col)


def _judged(found: DataFrame, model: RandomForestClassificationModel, threshold: float) -> DataFrame:
    chance = vector_to_array("probability")[1]
    return model.transform(with_features(found)).select("row", "id", "start", "end", "value", chance.alias("probability"), (chance >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """docs with every secret replaced by the mark; all rows and columns stay. Only rows with a candidate are numbered,
    written and joined with their spans, by their number: ids may be null or repeated. The others pass through."""
    text = F.col(f"`{text_col}`")
    asked = F.coalesce(text.rlike(CANDIDATE), F.lit(False))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hit = cut(docs.where(asked).select(F.monotonically_increasing_id().alias("row"), text.alias("text"), whole.alias("whole")), "candidates")
    spans = _judged(_candidates(hit.select("row", F.lit(None).alias("id"), "text")), model, threshold).where("is_secret")
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("text").cast("long")))
    parts = F.zip_with(begins, ends, lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int")))
    made = F.when(F.size("spans") > 0, F.concat_ws(mark, parts)).otherwise(F.col("text"))
    joined = hit.join(spans, "row", "left").select(made.alias("made"), "whole")
    changed = joined.select(*[(F.col("made") if c == text_col else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])
    return changed.unionByName(docs.where(~asked))
