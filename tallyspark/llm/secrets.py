"""Operator 7: secrets in texts, with a random forest that removes false findings, in DataFrame expressions only.

Candidates are long runs of key characters in words with a digit, and values of eight or more characters of any kind that follow
an assignment or a neighbour that speaks for a secret. A forest over their length, changes of character class, coverage by
dictionary words, path shape and neighbouring words tells secrets from card numbers, digests, paths and placeholders. It is
trained from labelled findings and written out as one Spark expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, texts

#: Least length of a candidate.
SHORTEST = 16
#: Least length of a value that its neighbours make a candidate.
NAMED = 8
TREES, DEPTH, LEAF = 15, 5, 5
#: Labelled findings that the forest is trained on.
SAMPLE = 6_000
MARK = "[SECRET]"

CORE = "[A-Za-z0-9_+/=.~-]{%d,}" % SHORTEST
#: Between two runs of a word: what stands up to the first of these goes with the run before, what follows it with the run after.
BREAK = ",;&|"
#: Words that names, paths and placeholders are made of.
WORDS = (
    "about access account address admin alpha android application archive array assets author backup banner beta binary block board branch browser bucket build button cache camera canvas change channel "
    "check class client cloud cluster code color column command comment common company complete config connection console contact content context control copy core counter country create current "
    "customer data database date debug default delete demo deploy detail device dialog document domain download driver dummy email empty engine entity entry error event example export factory fake "
    "feature field file filter final folder form format frame function gallery global graph group handler header history home host html http icon image import index info input install instance "
    "integration interface internal invoice item java json label language latest layout legacy level library license line link list local location login logo main manager market master media member "
    "memory menu message meta method mobile mock model module monitor name network node note object offer office online option order output owner package page panel parent part partner pass payment "
    "person phone photo picture placeholder platform player plugin point policy portal position post preview price print private process product profile program project property provider public "
    "query queue random range read record region release remote report request resource response result review root route sale sample schema screen script search section select sender sequence server "
    "service session setting shared shop signature simple site size snapshot source special spring stable stage standard start state static status storage store stream string style support system "
    "table target task team template terminal test text theme thread thumb ticket time title tool topic track transaction type unit update upload user utility value vendor version video view virtual "
    "volume week widget window word work worker year your zone here insert replace changeme"
).split()
#: Neighbours that speak for and against a secret.
FOR = r"(?i)(^|[^a-z])(key|apikey|api_key|token|secret|password|passwd|pwd|auth|bearer|credential|credentials|authorization|access_key|private)([^a-z]|$)"
AGAINST = r"(?i)(^|[^a-z])(commit|sha|sha1|sha256|md5|hash|digest|checksum|uuid|guid|revision|version|card|phone|order|invoice|isbn|serial|tracking|id)([^a-z]|$)"

#: What keys of well-known makers begin with.
PREFIX = r"^(AKIA[0-9A-Z]|ASIA[0-9A-Z]|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|npm_|hf_|pypi-|SG\.)"
#: A value assigned within a word, links left out, up to a sign that no value goes on behind (& only before another name); a password in a link; the end of a word after which a value
#: stands; a value's quotes and what encloses it.
INSIDE = r"(?<=[A-Za-z0-9_][\"'`]{0,1}[=:])(?!//)(?:[\"'`][^\"'`]{%d,}[\"'`]|[^\"'`&;,<>=:](?:[^\"'`&;,<>]|&(?![A-Za-z0-9_.-]{1,60}=)){%d,})" % (NAMED, NAMED - 1)
LINKED = r"://[^/:@?#]*:([^/@]{%d,})@[A-Za-z0-9]" % (NAMED - 2)
#: What every text with a candidate has.
GATE = r"(?i)[=:]|[A-Za-z0-9_+/=.~-]{%d,}|key|token|secret|passw|pwd|auth|bearer|credential|private" % SHORTEST
ASSIGNS = r"[=:][\"'`]?$"
QUOTED = r"[\"'`]([^\"'`]{%d,})[\"'`]" % NAMED
AROUND = r"^[\"'`(<\[{]+|[\"'`)>\]},;.:]+$"

FEATURES = ("length", "digits", "upper", "hexadecimal", "only_digits", "distinct", "changes", "dictionary", "slashes", "dots", "quoted", "assigned", "neighbour_for", "neighbour_against",
    "in_word", "prefixed", "linked")


def _share(c: Column, kind: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, f"[{kind}]+", ""))) / F.length(c)


def features(core: Column, word: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers about the candidate ``core`` in ``word``; ``before`` and ``after`` are its neighbours as text."""
    size = F.greatest(F.length(core), F.lit(1))
    flag = lambda c: c.cast("double")
    return {
        "length": F.length(core).cast("double"),
        "digits": _share(core, "0-9"),
        "upper": _share(core, "A-Z"),
        "hexadecimal": flag(core.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "only_digits": flag(core.rlike(r"^[0-9.+-]+$")),
        "distinct": F.size(F.array_distinct(F.split(core, ""))) / size,
        "changes": (F.size(F.regexp_extract_all(core, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), 0)) - 1) / size,
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(core), "|".join(sorted(WORDS, key=len, reverse=True)), "")) / size,
        "slashes": F.size(F.split(word, "/")) - 1.0,
        "dots": F.size(F.split(core, r"\.")) - 1.0,
        "quoted": flag(word.rlike(r"[\"'`]")),
        "assigned": flag(F.concat_ws(" ", before, word).rlike(r"[=:]\s*[\"'`]?" + CORE) | F.concat_ws(" ", before, F.split_part(word, core, F.lit(1))).rlike(r"[=:]\s*[\"'`]?$")),
        "neighbour_for": flag(F.concat_ws(" ", before, F.replace(word, core, F.lit(" "))).rlike(FOR) | word.rlike(r"(?i)(key|token|secret|password|auth)[\"']?[=:]")),
        "neighbour_against": flag(F.concat_ws(" ", before, F.replace(word, core, F.lit(" ")), after).rlike(AGAINST)),
        "in_word": (F.length(word) - F.length(core)).cast("double"),
        "prefixed": flag(core.rlike(PREFIX)),
        "linked": flag(F.contains(word, F.concat(F.lit(":"), core, F.lit("@"))) & F.contains(word, F.lit("://"))),
    }


@dataclass
class Node:
    value: float
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> Node:
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return node
    best = (1e-9, -1, 0.0)
    impurity = y.mean() * (1 - y.mean())
    for k in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False).tolist():
        order = np.argsort(x[:, k], kind="stable")
        v, sums = x[order, k], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= LEAF) & (at <= len(y) - LEAF)]
        if not len(at):
            continue
        a, b = sums[at - 1] / at, (sums[-1] - sums[at - 1]) / (len(y) - at)
        gain = impurity - (at * a * (1 - a) + (len(y) - at) * b * (1 - b)) / len(y)
        j = int(np.argmax(gain))
        if gain[j] > best[0]:
            best = (float(gain[j]), k, float((v[at[j]] + v[at[j] - 1]) / 2))
    if best[1] >= 0:
        node.feature, node.threshold = best[1], best[2]
        low = x[:, node.feature] <= node.threshold
        node.low, node.high = _tree(x[low], y[low], rng, depth - 1), _tree(x[~low], y[~low], rng, depth - 1)
    return node


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Node]:
    """Trees on bootstrap samples, each split on a random part of the features. Without rows nothing is a secret."""
    rng = np.random.default_rng(seed)
    if not len(y):
        return [Node(0.0)]
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_tree(x[rows], y[rows], rng, depth))
    return out


def probability(forest: list[Node], value: Callable[[str], Column]) -> Column:
    """The forest's mean vote; ``value`` gives a feature's column."""

    def of(node: Node) -> Column:
        if node.feature < 0:
            return F.lit(node.value)
        return F.when(value(FEATURES[node.feature]) <= node.threshold, of(node.low)).otherwise(of(node.high))

    total = of(forest[0])
    for tree in forest[1:]:
        total = total + of(tree)
    return total / len(forest)


def made_findings(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    """Labelled findings (word, before, after, secret) made from row numbers: keys, tokens and passwords, and what is taken for them: card numbers, digests, ids, paths, links, versions and placeholders."""
    rows = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("r"))
    rows = rows.withColumn("b64", F.translate(F.base64(F.unhex("h")), "=", "")).withColumn("num", F.rpad(F.regexp_replace(F.conv(F.substring("h", 1, 15), 16, 10), "[^0-9]", ""), 16, "4"))
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.col("r"), F.lit(len(words))) + 1).cast("int"))
    h, num, b64 = F.col("h"), F.col("num"), F.col("b64")
    known = F.split(F.lit(" ".join(WORDS)), " ")
    at = lambda k: F.element_at(known, (F.pmod(k, F.lit(len(WORDS))) + 1).cast("int"))
    rows, word = rows.withColumn("w", F.concat(at(F.col("r")), F.lit("_"), at(F.col("r") * 7))), F.col("w")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    prose = pick("the", "of it", "and this", "that was", "in a")
    cases = [
        (quote(F.substring(h, 1, 40)), F.concat(prose, F.lit(" "), pick("token =", "key =", "secret =", "password =", "api_key =")), prose, 1),
        (F.substring(b64, 1, 32), F.concat(prose, F.lit(" "), pick("secret:", "token:", "Bearer", "password:", "access key:")), prose, 1),
        (F.concat(pick("key=", "token=", "secret=", "API_KEY=", "password="), F.substring(b64, 5, 28)), prose, prose, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(h, 3, 16))), F.concat(prose, F.lit(" "), pick("key", "aws access key", "id =")), prose, 1),
        (F.concat(pick("ghp_", "sk-", "xoxb-", "glpat-"), F.substring(b64, 3, 36)), prose, prose, 1),
        (quote(F.substring(h, 1, 32)), pick("auth token =", "client secret =", "password :", "secret key ="), prose, 1),
        (F.substring(num, 1, 16), prose, prose, 0),
        (F.concat(F.lit("+1"), F.substring(num, 1, 16)), F.concat(prose, F.lit(" phone")), prose, 0),
        (F.substring(h, 1, 40), F.concat(prose, F.lit(" "), pick("commit", "sha1", "revision", "checksum")), prose, 0),
        (h, F.concat(prose, F.lit(" "), pick("sha256 =", "digest:", "hash =", "checksum")), prose, 0),
        (F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)),
            F.concat(prose, F.lit(" "), pick("uuid", "request id", "order", "guid")), prose, 0),
        (F.concat(F.lit("https://www.example.com/"), word, F.lit("/"), F.substring(num, 1, 6), F.lit("/"), word), prose, prose, 0),
        (F.concat(F.lit("src/"), word, F.lit("/v2/"), word, F.lit("_"), F.substring(num, 1, 2), F.lit(".py")), prose, prose, 0),
        (F.concat(word, F.lit("-"), F.substring(num, 1, 1), F.lit("."), F.substring(num, 2, 2), F.lit(".0-release")), prose, prose, 0),
        (quote(F.concat(pick("your_api_key_here_", "xxxxxxxxxxxxxxxx", "example_token_", "changeme_secret_", "000000000000000"), F.substring(num, 1, 2))),
            pick("token =", "key =", "secret ="), prose, 0),
        (F.concat(F.lit("2024-0"), F.substring(num, 1, 1), F.lit("-11T10:20:3"), F.substring(num, 2, 1), F.lit("Z-backup")), prose, prose, 0),
        (F.concat(word, F.lit("."), F.substring(num, 1, 2), F.lit("@mail"), F.substring(num, 1, 1), F.lit(".example.com")), prose, prose, 0),
    ]
    letters = F.translate(b64, "0123456789+/", "ghkmpqrtvxyz")
    low, naming = F.translate(h, "0123456789", "ghkmopqrtu"), pick("password:", "passwd =", "pwd =", "secret:", "login password:", "token =")
    plain = pick("status:", "name =", "title:", "as follows:", "mode =", "note:")
    cases += [
        (F.substring(b64, 7, 9), F.concat(prose, F.lit(" "), naming), prose, 1),
        (quote(F.substring(b64, 2, 11)), F.concat(prose, F.lit(" "), naming), prose, 1),
        (F.concat(F.substring(b64, 1, 4), F.lit("!"), F.substring(b64, 9, 3), pick("#", "@", "$", "%"), F.substring(b64, 15, 5)), F.concat(prose, F.lit(" "), naming), prose, 1),
        (F.concat(pick("password=", "pwd=", "passwd:", "secret="), F.substring(b64, 1, 5), pick("!", "@", "$"), F.substring(b64, 9, 5)), prose, prose, 1),
        (F.substring(letters, 1, 24), F.concat(prose, F.lit(" "), naming), prose, 1),
        (quote(F.substring(low, 1, 14)), F.concat(prose, F.lit(" "), naming), prose, 1),
        (quote(F.concat(F.substring(low, 1, 6), F.lit("-"), F.substring(low, 9, 5), F.lit("-"), F.substring(low, 17, 7))), F.concat(prose, F.lit(" "), naming), prose, 1),
        (F.concat(prose, F.substring(low, 1, 9)), F.concat(prose, F.lit(" "), pick("password", "key", "secret", "token", "private", "the key is")), prose, 0),
        (F.substring(low, 1, 10), F.concat(prose, F.lit(" "), naming), prose, 0),
        (F.substring(low, 1, 11), F.concat(prose, F.lit(" "), plain), prose, 0),
        (F.concat(F.initcap(F.substring(low, 1, 9)), F.lit(",")), F.concat(prose, F.lit(" "), plain), prose, 0),
        (F.substring(b64, 3, 10), F.concat(prose, F.lit(" "), plain), prose, 0),
        (quote(F.substring(low, 5, 12)), F.concat(prose, F.lit(" "), plain), prose, 0),
        (F.substring(num, 1, 9), F.concat(prose, F.lit(" "), pick("order:", "id =", "invoice:", "amount:")), prose, 0),
        (word, F.concat(prose, F.lit(" "), naming), prose, 0),
        (F.concat(pick("status=", "name:", "mode=", "title="), F.substring(low, 1, 10)), prose, prose, 0),
    ]
    mixed = F.concat(F.upper(F.substring(h, 1, 9)), F.substring(h, 10, 12), F.upper(F.substring(h, 22, 15)))
    server = F.concat(F.lit("db"), F.substring(num, 1, 2), F.lit(".example.com:5432/"), word)
    cases += [
        (F.concat(pick("ghp_", "sk-", "glpat-", "gho_", "hf_"), mixed), prose, prose, 1),
        (F.concat(pick("AKIA", "ASIA", "AKIA"), F.upper(F.substring(h, 5, 16))), prose, prose, 1),
        (F.concat(pick("postgres", "mysql", "https", "amqp"), F.lit("://"), word, F.lit(":"), F.substring(b64, 3, 12), F.lit("@"), server), prose, prose, 1),
        (F.concat(pick("postgres", "redis", "https", "ftp"), F.lit("://"), F.lit("admin:"), F.substring(low, 3, 10), F.lit("@"), server), prose, prose, 1),
        (F.concat(pick("postgres", "mysql", "https", "amqp"), F.lit("://"), server), prose, prose, 0),
        (F.substring(low, 1, 22), F.concat(prose, F.lit(" "), pick("secret =", "password =", "passwd:", "secret key =")), prose, 1),
        (F.concat(F.lit('"'), pick("sha1", "commit", "digest", "checksum", "md5"), F.lit('":"'), F.substring(h, 1, 40), F.lit('"')), prose, prose, 0),
        (F.concat(F.lit('"'), pick("token", "secret", "api_key", "password"), F.lit('":"'), F.substring(h, 1, 40), F.lit('"')), prose, prose, 1),
        (F.concat(pick("password=", "DB_PASSWORD=", "secret=", "pwd="), F.substring(b64, 1, 9), F.lit("&"), F.substring(num, 1, 1)), prose, prose, 1),
    ]
    out = None
    for k, (w, before, after, label) in enumerate(cases):
        case = F.struct(w.alias("word"), before.alias("before"), after.alias("after"), F.lit(label).alias("secret"))
        out = F.when(F.pmod("id", F.lit(len(cases))) == k, case) if out is None else out.when(F.pmod("id", F.lit(len(cases))) == k, case)
    return rows.select("id", out.alias("f")).select("id", "f.*")


def training_rows(findings: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """id, secret and the features of the first ``sample`` by hash of labelled findings (id, word, before, after, secret), without those that have no label or no candidate."""
    word = F.col("word")
    core = F.when(word.rlike(CORE) & ~word.rlike(LINKED), F.regexp_extract(word, CORE, 0)).otherwise(F.get(_values(word, F.lit(True)), F.lit(0)))
    # The row number is not deterministic: else the filter would be pushed down, and what makes a finding be repeated in it for each time that ``core`` names the word.
    findings = findings.withColumns({"core": core, "__row": F.monotonically_increasing_id()})
    f = features(F.col("core"), word, F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    few = findings.where(F.col("secret").isNotNull() & F.col("core").isNotNull() & (F.col("__row") >= 0)).orderBy(F.xxhash64("id"), "id").limit(sample)
    return few.select("id", "secret", *(c.cast("double").alias(n) for n, c in f.items()))


def fit(findings: DataFrame, sample: int = SAMPLE) -> list[Node]:
    """A forest from labelled findings, as :func:`training_rows` takes them."""
    rows = training_rows(findings, sample).collect()
    rows.sort(key=lambda r: r["id"])
    return train(np.asarray([[r[n] for n in FEATURES] for r in rows], dtype=float).reshape(-1, len(FEATURES)), np.asarray([r["secret"] for r in rows], dtype=float))


def _values(word: Column, named: Column) -> Column:
    """The values assigned within a word, or else the word as a whole if it is ``named`` by what stands before it; without quotes, NAMED characters at least."""
    inside = F.transform(F.regexp_extract_all(word, F.lit(INSIDE), F.lit(0)), lambda x: F.regexp_replace(x, AROUND, ""))
    bare = F.when(word.rlike(QUOTED), F.regexp_extract(word, QUOTED, 1)).otherwise(F.regexp_replace(word, AROUND, ""))
    every = F.when(word.rlike(LINKED), F.array(F.regexp_extract(word, LINKED, 1))).when(word.rlike(INSIDE), inside).when(named, F.array(bare)).otherwise(F.array().cast("array<string>"))
    return F.filter(every, lambda x: (F.length(x) >= NAMED) | word.rlike(LINKED))


def _runs(parts: Column) -> Column:
    """The candidates of a word (f, cores, rests, values): one for each run of key characters, the run with what stands beside it in the word, and its neighbours, of which the nearest runs of the
    word are the first; and one for each value that no run holds."""
    f, cores, rests = parts["f"], parts["cores"], parts["rests"]
    last = F.size(cores) - 1

    def run(core: Column, k: Column) -> Column:
        left, right = F.get(rests, k), F.get(rests, k + 1)
        left = F.when(k > 0, F.regexp_replace(left, f"^[^{BREAK}]*[{BREAK}]", "")).otherwise(left)
        right = F.when(k < last, F.regexp_extract(right, f"^[^{BREAK}]*", 0)).otherwise(right)
        return F.struct(f["place"].alias("place"), F.lit(False).alias("named"), core.alias("core"), F.concat(left, core, right).alias("word"),
            F.concat_ws(" ", f["before"], F.get(cores, k - 1)).alias("before"), F.concat_ws(" ", F.get(cores, k + 1), f["after"]).alias("after"))

    def value(core: Column) -> Column:
        left = F.regexp_extract(F.split_part(f["word"], core, F.lit(1)), f"[^{BREAK}]*$", 0)
        right = F.regexp_extract(F.split_part(f["word"], core, F.lit(2)), f"^[^{BREAK}]*", 0)
        return F.struct(f["place"].alias("place"), F.lit(True).alias("named"), core.alias("core"), F.concat(left, core, right).alias("word"), f["before"].alias("before"), f["after"].alias("after"))

    def outgrown(core: Column) -> Column:
        """A run that ends inside a value which it assigns, and which goes on behind it with other signs."""
        tail = F.substring_index(core, "=", -1)
        return F.contains(core, F.lit("=")) & (tail != "") & F.exists(parts["values"], lambda x: F.startswith(x, tail) & (F.length(x) > F.length(tail)))

    lone = F.filter(F.array_distinct(parts["values"]), lambda x: ~F.exists(cores, lambda c: F.contains(c, x)))
    return F.concat(F.filter(F.transform(cores, run), lambda r: ~outgrown(r["core"])), F.transform(lone, value))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __found: for each candidate the place of its word among the words, itself, what stands beside it in the word, and its neighbours."""
    words = F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES)), r"[\x20\x09-\x0D]+")
    held = docs.withColumn("__words", F.when(F.col(text).rlike(GATE), words).otherwise(F.array().cast("array<string>")))
    near = lambda i, *steps: F.concat_ws(" ", *(F.get("__words", i + s) for s in steps))
    long = lambda w: (F.length(w) >= SHORTEST) & w.rlike("[0-9]") & w.rlike(CORE)
    named = lambda i: near(i, -1).rlike(ASSIGNS) | near(i, -2, -1).rlike(FOR)
    at = F.transform("__words", lambda w, i: F.when((F.length(w) >= NAMED) & (long(w) | w.rlike(INSIDE) | w.rlike(LINKED) | named(i)), i))
    held = held.withColumn("__at", F.filter(at, lambda i: i.isNotNull()))
    held = held.withColumn("__found", F.transform("__at",
        lambda i: F.struct(i.alias("place"), F.get("__words", i).alias("word"), near(i, -3, -2, -1).alias("before"), near(i, 1, 2).alias("after"), named(i).alias("named"))))
    none = F.array().cast("array<string>")
    parts = F.transform("__found", lambda f: F.struct(f.alias("f"), F.when(long(f["word"]), F.regexp_extract_all(f["word"], F.lit(CORE), F.lit(0))).otherwise(none).alias("cores"),
        F.split(f["word"], CORE, -1).alias("rests"), _values(f["word"], f["named"]).alias("values")))
    return held.withColumn("__found", F.flatten(F.transform(parts, _runs))).drop("__words", "__at")


def findings(docs: DataFrame, forest: list[Node], limit: float = 0.5) -> DataFrame:
    """doc_id, place (word position from 0, the same for all candidates of a word), masked (first four characters), length, score, secret: a row for each candidate in each row of ``docs``. Null and
    empty texts have none."""
    rows = with_candidates(texts(docs)).select("doc_id", F.explode_outer("__found").alias("f")).where("f is not null")  # outer: else a filter on the array's size would be pushed down
    core = F.col("f.core")
    rows = rows.select("doc_id", F.col("f.place").cast("long").alias("place"), F.concat(F.substring(core, 1, 4), F.lit("…")).alias("masked"), F.length(core).cast("long").alias("length"),
        *(c.cast("double").alias(f"__{n}") for n, c in features(core, F.col("f.word"), F.col("f.before"), F.col("f.after")).items()))
    # within a lambda, as the forest's conditions are more code than one compiled method may have
    vector = F.array(F.struct(*(F.col(f"__{n}").alias(n) for n in FEATURES)))
    score = F.transform(vector, lambda v: probability(forest, lambda n: v[n]))[0]
    return rows.withColumn("score", score).select("doc_id", "place", "masked", "length", "score", (F.col("score") >= limit).alias("secret"))


def redacted(docs: DataFrame, forest: list[Node], limit: float = 0.5) -> DataFrame:
    """``docs`` with their columns; each secret in the text stands as MARK. Null texts stay null."""
    names = docs.columns
    spare = docs.select(*(F.col(f"`{n}`").alias(f"__c{k}") for k, n in enumerate(names)), F.col("text").alias("__text"))
    held = with_candidates(spare, "__text")
    vector = F.transform("__found", lambda f: F.struct(f["core"].alias("core"), f["place"].alias("place"), f["named"].alias("named"),
        *(c.cast("double").alias(n) for n, c in features(f["core"], f["word"], f["before"], f["after"]).items())))
    held = held.withColumn("__vectors", vector)
    held = held.withColumn("__sure", F.transform(F.filter("__vectors", lambda v: probability(forest, lambda n: v[n]) >= limit),
        lambda v: F.struct(v["core"].alias("core"), v["place"].alias("place"), v["named"].alias("named"))))
    # Longest first: else one that is part of another would leave the rest of it.
    cores = lambda found: F.array_sort(F.array_distinct(F.transform(found, lambda v: v["core"])), lambda a, b: F.length(b) - F.length(a))
    masked = lambda text, found: F.aggregate(cores(found), text, lambda t, s: F.replace(t, s, F.lit(MARK)))
    # Values may be common words elsewhere, so they are masked in their own words only.
    words, gaps = F.regexp_extract_all("__text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.split("__text", r"[^\x20\x09-\x0D]+", -1)
    own = F.transform(words, lambda w, i: masked(w, F.filter("__sure", lambda v: v["place"] == i)))
    text = F.when(F.exists("__sure", lambda v: v["named"]), F.array_join(F.zip_with(gaps, own, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")).otherwise(F.col("__text"))
    clean = masked(text, F.filter("__sure", lambda v: ~v["named"]))
    held = held.withColumn("__clean", F.when(F.size("__vectors") > 0, clean).otherwise(F.col("__text")))
    return held.select(*(F.col("__clean" if n == "text" else f"__c{k}").alias(n) for k, n in enumerate(names)))
