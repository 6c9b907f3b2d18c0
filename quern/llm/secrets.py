"""Secret scans: candidates, then a random forest that removes false positives (DataFrame functions only).

Candidates are private key blocks, signed web tokens, passwords in URLs, values assigned to telling names (six characters or
more), and runs of 16 or more key-like characters that hold a digit or mix cases.  The forest sees a candidate's length,
character transitions and make-up, known beginnings, how much of it dictionary words cover, the path (or source) of
the document, and the neighbouring words, which are read from the text around it, other candidates included.  It is trained from
labelled findings (made by rule below, a fixed number) whose features come from the very expressions that scan, and runs as nested
CASE expressions inside the scan: one narrow projection, no shuffle, whatever the number of candidates of a document.

Edge cases: a null or empty text has no candidates and stays as it is; repeated rows are scanned alike; candidates
and columns are compared by value only, so ties do not arise.  Columns of docs are carried through unless they clash
with an output name, in which case the output wins; an empty table gives no rows.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYLIKE = "A-Za-z0-9_+/-"
NAMES = "passw(?:or)?d|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|credential"
#: The kinds of candidates, the first that fits a place wins.
KINDS = [
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,20000}+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?",
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?",
    r"(?<=[^\s/]:)(?=[^\s/@]{3,}+@)(?<=[a-z]://[^\s/:@]{1,40}:)[^\s/@]{3,}+",
    rf"(?<=[:= \t\"'`])(?<=[:=][ \t]{{0,2}}[\"'`]?)(?<=(?i:{NAMES})[\"']?[ \t]{{0,2}}[:=]{{1,2}}[ \t]{{0,2}}[\"'`]?)[^\s\"'`,;:=][^\s\"'`,;]{{5,}}+",
    rf"(?<![{KEYLIKE}])[{KEYLIKE}]{{16,}}+={{0,2}}+(?![{KEYLIKE}=])",
]
CANDIDATE = "|".join(f"(?:{k})" for k in KINDS)
#: A cheap test that every text with a candidate passes.
SOME = rf"[{KEYLIKE}]{{16}}|PRIVATE KEY|://[^\s/:@]++:[^\s/@]{{3,}}+@|(?i:{NAMES})[\"']?[ \t]{{0,2}}[:=]"
#: Characters of context on either side.
BEFORE, AFTER = 48, 32
MASK = "<secret>"

#: Words of the dictionary, of names in programs, of paths that hold samples, and beside true and false findings.
DICTIONARY = "the and that with this from have what which their would there about other words time some could people than first water been call who its now find long down day did get come made may part over new sound take only little work know place year live back give most very after thing our just name good sentence man think say great where help through much before line right too mean old any same tell boy follow came want show also around form three small set put end does another well large must big even such because turn here why ask went men read need land different home move try kind hand picture again change off play spell air away animal house point page letter mother answer found study still learn should world example sample placeholder version release package module library function".split()
PROGRAM_WORDS = "abstract access account action adapter address admin application argument array async authentication authorization base basic boolean buffer builder bundle cache callback channel class client cluster collection command common component config configuration connection container content context controller converter count counter create credential current customer data database default delegate delete description device document domain download element email enable encoder entity entry environment error event exception executor export external factory field file filter format frame gateway generator group handler header helper identifier image implementation import index info input instance interface internal item java json label layer listener loader local location logger login manager mapper message metadata method model module monitor native network node null number object observer option order output override page parameter parser password path payload pipeline player plugin pointer policy port prefix private process processor product profile project property protocol provider proxy public query queue reader record registry remote render repository request required resolver resource response result return role root route router schema scheduler scope script search secret security select sender serializer server service session setting settings signature simple socket source spring state static status storage store strategy stream string style support switch system table target task template text thread timeout title token transaction transform type update upload user util utils validator value variable vector view warning widget window worker wrapper writer none true false".split()
SAMPLE_PATHS = ["test", "example", "fixture", "mock", "sample", "docs"]
SECRET_WORDS = ["token", "secret", "api_key", "apikey", "api-key", "passw", "passwd", "pwd", "passphrase", "auth", "credential", "bearer", "private", "access_key", "client_secret", "signing"]
BENIGN_WORDS = ["sha1", "sha256", "md5", "checksum", "digest", "commit", "revision", "uuid", "guid", "isbn", "order", "invoice", "phone", "card", "example", "placeholder", "dummy", "your_", "sample", "href", "http:", "https:"]
PREFIXES = "^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|sk-|sk_live_|rk_live_|AIza|npm_|SG[.]|eyJ|-----BEGIN|ya29[.])"
EMPTY_WORDS = "(?i)your|change.?me|x{4,}|0{6,}|1234567|placeholder|redacted|example|dummy|todo|[*]{3,}|[.]{3,}|none|null|undefined|true|false|required|optional|string|env|process[.]|config[.]|settings[.]|get[A-Z(]|[$][{(]|[{][{]|<[a-z]|%[(s]|[(][)]"
FEATURES = ("length", "transitions", "digits", "vowels", "distinct", "hex", "covered", "marks", "prefix", "stand_in", "identifier", "sample_path", "secret_word", "benign_word", "assigned", "quoted", "in_url")


def _any(words: list[str]) -> str:
    return "(?i)" + "|".join(words)


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of doubles named as FEATURES."""
    n = F.length(value).cast("double")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "_")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double") / n
    uncovered = F.length(F.regexp_replace(F.lower(F.substring(value, 1, 256)), "|".join(sorted({w for w in DICTIONARY + PROGRAM_WORDS if len(w) > 3}, key=lambda w: (-len(w), w))), "")) / F.least(n, F.lit(256.0))
    return F.struct(
        n.alias("length"),
        ((F.length(runs) - 1) / (n - 1)).alias("transitions"),
        share("[0-9]").alias("digits"),
        share("[aeiouAEIOU]").alias("vowels"),
        (F.size(F.array_distinct(F.split(value, ""))).cast("double") / F.least(n, F.lit(64.0))).alias("distinct"),
        flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        (F.lit(1.0) - uncovered).alias("covered"),
        share("[^A-Za-z0-9]").alias("marks"),
        flag(value.rlike(PREFIXES)).alias("prefix"),
        flag(value.rlike(EMPTY_WORDS)).alias("stand_in"),
        flag(value.rlike("^[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)+[A-Za-z]?[0-9]{0,3}$|^[A-Za-z]+(?:[_./-][A-Za-z]+)+[0-9]{0,3}$")).alias("identifier"),
        flag(path.rlike(_any(SAMPLE_PATHS))).alias("sample_path"),
        flag(before.rlike(_any(SECRET_WORDS))).alias("secret_word"),
        flag(F.concat(before, F.lit(" "), after).rlike(_any(BENIGN_WORDS))).alias("benign_word"),
        flag(before.rlike("[:=]\\s*[\"'`]?$")).alias("assigned"),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).alias("quoted"),
        flag(before.rlike("://[^\\s/:@]{1,40}:$") & after.startswith("@")).alias("in_url"),
    )


def labelled_findings(n: int = 1200, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, is a secret): n findings made by rule, the labels of the training."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    alnum, hexa, capitals = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits
    word = lambda: r.choice(DICTIONARY)
    term = lambda: r.choice(PROGRAM_WORDS)
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 5)))
    names = ["token", "secret", "api_key", "apikey", "password", "passwd", "DB_PASSWORD", "auth_token", "access_key", "client_secret", "AWS_SECRET_ACCESS_KEY", "aws_secret_access_key", "TOKEN", "API_KEY", "Authorization: Bearer", "bearer", "private_key"]
    camel = lambda k: "".join(w.capitalize() for w in (term() for _ in range(k)))
    found = []
    for k in range(n):
        path = r.choice(["src3", "src/app.py", "config/settings.yml", "notes", "src12", ""])
        open_, shut = r.choice([('"', '"'), ("'", "'"), ('"', '",'), ("", "")])
        assign = lambda name: f"{prose()} {name}{r.choice([' = ', '=', ': ', ' := ', '=> '])}{open_}"
        if k % 2 == 0:  # a secret
            kind = r.randrange(10)
            if kind < 4:  # a random value under a telling name
                size = r.choice([16, 20, 24, 32, 40, 40, 40, 48, 64])
                value = r.choice([pick(hexa, size), pick(hexa, size).upper(), pick(alnum, size), pick(alnum + "+/", size), pick(alnum + "_-", size), pick(alnum + "+/", size - 2) + "=="])
                found.append((value, assign(r.choice(names)), f"{shut} {prose()}", path, 1))
            elif kind < 7:  # a known beginning, whatever stands around it
                value = r.choice(["ghp_" + pick(alnum, 36), "AKIA" + pick(capitals, 16), "sk-" + pick(alnum, 40), f"xoxb-{pick(string.digits, 12)}-{pick(string.digits, 12)}-{pick(alnum, 24)}", "glpat-" + pick(alnum + "-_", 20), "AIza" + pick(alnum + "-_", 35), "sk_live_" + pick(alnum, 24), "eyJ" + pick(alnum, 33) + ".eyJ" + pick(alnum, 60) + "." + pick(alnum + "-_", 43), "-----BEGIN RSA PRIVATE KEY-----" + pick(alnum + "+/", 400) + "-----END RSA PRIVATE KEY-----"])
                found.append((value, r.choice([assign(r.choice(names)), f"{prose()} ", f"{prose()} {open_}"]), f"{shut} {prose()}", path, 1))
            elif kind == 7:  # a password in a URL
                value = r.choice([pick(alnum, r.randint(8, 20)), word() + pick(string.digits, 3) + r.choice("!#%") + pick(alnum, 3)])
                found.append((value, f"{prose()} {r.choice(['postgres', 'https', 'amqp', 'mysql', 'redis'])}://{word()}:", f"@{word()}.{word()}:5432/{word()}", path, 1))
            else:  # a short password
                value = r.choice([word().capitalize() + pick(string.digits, 3) + r.choice("!#$%&*"), pick(alnum + "!#$%&*", r.randint(8, 14)), r.choice("ABCDEFGH") + pick(string.ascii_lowercase + string.digits, 7) + r.choice("!#$") + pick(string.digits, 2), word() + pick(string.digits, 4) + word().upper()])
                found.append((value, assign(r.choice(["password", "passwd", "DB_PASSWORD", "pwd", "secret", "passphrase"])), f"{shut} {prose()}", path, 1))
            continue
        kind = r.randrange(12)
        if kind in (0, 1):  # card, order and telephone numbers in prose or tables
            found.append((pick(string.digits, r.choice([16, 16, 16, 18, 20])), r.choice([f"{prose()} ", f"{prose()} | ", f"order {word()} ", "card: "]), f" {prose()}", path, 0))
        elif kind == 2:  # digests under a telling name
            found.append((pick(hexa, r.choice([32, 40, 64])), f"{r.choice(['sha256', 'md5', 'commit', 'checksum', 'revision'])}{r.choice([': ', ' = ', ' '])}{open_}", f"{shut} {prose()}", path, 0))
        elif kind == 3:  # stand-ins
            value = r.choice(["your_api_key_here_123", "EXAMPLEKEY1234567890", "xxxxxxxxxxxxxxxxxxxx1", "0000000000000000000000", "changeme_changeme_1", "changeme", "<your-token>", "${DB_PASSWORD}", "{{ password }}", "getPassword()", "process.env.API_TOKEN", "os.environ", "config.secret_key", "required", "undefined", "string", "********", "placeholder"])
            found.append((value, assign(r.choice(names)), f"{shut} {prose()}", r.choice(["tests/data/example.py", path]), 0))
        elif kind == 4:  # compound words with a number
            found.append(("-".join(word() for _ in range(r.randint(3, 6))) + "-" + pick(string.digits, 2), f"{prose()} ", f" {prose()}", path, 0))
        elif kind == 5:  # paths
            found.append(("/".join(word() for _ in range(r.randint(3, 6))) + "/v1", f"{prose()} ", f" {prose()}", path, 0))
        elif kind == 6:  # rows of digits run into marks
            found.append((r.choice(["_", "-", "+"]) * r.randint(8, 20) + pick(string.digits, 12), f"{prose()} ", f" {prose()}", path, 0))
        elif kind == 7:  # keys of tests
            found.append((pick(hexa, 32), f"uuid = {open_}", f"{shut} {prose()}", "tests/fixtures/mock.json", 0))
        elif kind in (8, 9):  # names of programs, telling names before them or not
            value = r.choice([camel(r.randint(2, 5)) + r.choice(["", "2", "10"]), term() + camel(r.randint(2, 4)), "_".join(term() for _ in range(r.randint(3, 5))), "_".join(term().upper() for _ in range(r.randint(3, 5))), ".".join(term() for _ in range(3))])
            found.append((value, r.choice([assign(r.choice(names)), f"{prose()} ", f"{prose()} ("]), f"{shut} {prose()}", path, 0))
        elif kind == 10:  # words of prose after a telling name
            found.append((r.choice([word() + word(), term() + "s", word() + "ing", "forgotten", "required.", "expired,"]), f"{prose()} {r.choice(['password', 'token', 'secret'])}: ", f" {prose()}", path, 0))
        else:  # long unbroken words
            found.append((pick("aeiounrstlh", r.randint(16, 30)).capitalize(), f"{prose()} ", f" {prose()}", path, 0))
    return found


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 21, depth: int = 7, seed: int = 3) -> list:
    """Random forest by Gini impurity: bootstrap rows, a random third of the features at each node.

    A tree is a leaf's share of secrets, or (feature, threshold, below, above); it goes below where feature <= threshold.
    """
    rng = np.random.default_rng(seed)
    n, m = x.shape

    def grow(rows: np.ndarray, left: int):
        p = y[rows].mean()
        if left == 0 or len(rows) < 6 or p in (0.0, 1.0):
            return round(float(p), 6)
        best = (np.inf, 0, 0.0)
        for f in rng.choice(m, max(2, m // 3), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, c = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1])
            if len(k):
                a, total = k + 1.0, float(len(rows))
                pa, pb = c[k] / a, (c[-1] - c[k]) / (total - a)
                gini = a * pa * (1 - pa) + (total - a) * pb * (1 - pb)
                j = int(np.argmin(gini))
                best = min(best, (float(gini[j]), int(f), float((v[k[j]] + v[k[j] + 1]) / 2)))
        if best[0] == np.inf:
            return round(float(p), 6)
        below = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[below], left - 1), grow(rows[~below], left - 1))

    return [grow(rng.integers(0, n, n), depth) for _ in range(trees)]


def forest_score(forest: list, at: Column) -> Column:
    """Mean of the trees' leaves as a column, from a struct of FEATURES."""

    def walk(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, limit, below, above = tree
        return F.when(at[FEATURES[f]] <= limit, walk(below)).otherwise(walk(above))

    total = walk(forest[0])
    for tree in forest[1:]:
        total = total + walk(tree)
    return total / len(forest)


_forests: dict = {}


def trained_forest(spark: SparkSession, findings: int = 1200, trees: int = 21, depth: int = 7) -> list:
    """The forest fitted to labelled_findings(findings); one tiny job the first time."""
    key = (spark.sparkContext.applicationId, findings, trees, depth)
    if key not in _forests:
        rows = labelled_findings(findings)
        table = spark.createDataFrame([(v, b[-BEFORE:], a[:AFTER], p, y) for v, b, a, p, y in rows], "v string, b string, a string, p string, y int")
        got = table.select(features(F.col("v"), F.col("b"), F.col("a"), F.col("p")).alias("f"), "y").select("f.*", "y").collect()
        x = np.array([[r[f] for f in FEATURES] for r in got])
        _forests[key] = grow_forest(x, np.array([float(r["y"]) for r in got]), trees, depth)
    return _forests[key]


def scan_secrets(docs: DataFrame, text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """docs with ``findings`` (array of value, score, is_secret, in order) and ``redacted`` (the text, secrets masked)."""
    forest = trained_forest(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("findings", "redacted")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    # cheap test first: most documents hold no candidate at all
    some = text.rlike(SOME)
    empty = F.array().cast("array<string>")
    rows = docs.select(*kept, F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(empty).alias("_values"), F.when(some, F.split(text, CANDIDATE)).otherwise(F.array(text)).alias("_parts"))
    zipped = F.transform(F.col("_values"), lambda v, i: F.struct(
        v.alias("value"), F.element_at("_parts", i + 1).alias("part"),
        F.concat(F.when(i > 0, F.substring(F.element_at("_values", F.greatest(i, F.lit(1))), -BEFORE, BEFORE)).otherwise(""), F.substring(F.element_at("_parts", i + 1), -BEFORE, BEFORE)).alias("before"),
        F.concat(F.substring(F.element_at("_parts", i + 2), 1, AFTER), F.substring(F.coalesce(F.try_element_at("_values", i + 2), F.lit("")), 1, AFTER)).alias("after"),
    ))

    def look(c: Column) -> Column:
        before, after = F.substring(c["before"], -BEFORE, BEFORE), F.substring(c["after"], 1, AFTER)
        keyed = c["value"].rlike("[0-9]") | (c["value"].rlike("[a-z]") & c["value"].rlike("[A-Z]")) | before.rlike("[:=][\\s]{0,2}[\"'`]?$")
        return F.struct(c["value"].alias("value"), c["part"].alias("before"), F.when(keyed, features(c["value"], before, after, path)).alias("f"))

    scored = F.transform(F.transform(zipped, look), lambda c: F.struct(c["value"].alias("value"), c["before"].alias("before"), F.when(c["f"].isNull(), 0.0).otherwise(forest_score(forest, c["f"])).alias("score"), c["f"].isNotNull().alias("candidate")))
    rows = rows.withColumn("_scored", scored)
    masked = F.concat(F.array_join(F.transform("_scored", lambda c: F.concat(c["before"], F.when(c["score"] >= threshold, F.lit(MASK)).otherwise(c["value"]))), ""), F.element_at("_parts", -1))
    findings = F.transform(F.filter("_scored", lambda c: c["candidate"]), lambda c: F.struct(c["value"].alias("value"), F.round(c["score"], 6).alias("score"), (c["score"] >= threshold).alias("is_secret")))
    return rows.select(*kept, findings.alias("findings"), F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(masked).alias("redacted"))
