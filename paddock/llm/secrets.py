"""Secret scans: broad patterns propose candidates, a random forest rejects the false ones.

Everything on the main path is DataFrame functions.  The forest is fitted with Spark ML on a bounded table of
labelled findings and then written out as one nested condition per tree, so that scoring happens inside the
projection that finds the candidates: one scan, no shuffle, no row of text leaves the JVM.
"""

from __future__ import annotations

import json
import random
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import written

#: Runs of at least 16 characters that keys, tokens and digests are written in.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
LABELLED_ROWS = 4_000  #: rows of the built-in labelled findings; fit() takes no more than this from any table
TREES, DEPTH, SECRET_FROM = 15, 6, 0.5

#: Common English letter pairs, frequent words, and words that often stand near secrets or digests.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
DICTIONARY = (
    "the and for with that this from have not are was his her their there which would about other into could than then them these some time make like only over such take year "
    "able tion ment ness less ing ous ive ent ence ance ist ion est heit keit lich isch schaft ung chen pfen ver ein ach ber mente ción ado que cion aux eau elle tre oire "
    "name user file path data test example sample value type list item index config default server client service project module package version release build source target "
    "image color font style page link site http https www html text number string object class method function return public private static final create update delete select insert "
    "count total first last next prev left right width height size table column row field"
).split()
#: user:password@ of an address: the part before the password, and such a password.
_LOGIN = r"://[^\s/:@\"'<>]{1,60}:"
NEAR_SECRET = r"(?i)(?:token|secret.key|secret|passw|passwd|api.?key|access.?key|auth|bearer|credential|private.?key|client.?key|pwd)\w*(?:\s+(?:is|was))?[^A-Za-z0-9]{0,6}$|" + _LOGIN + "$"
#: How tokens of widely used services begin.
KNOWN_PREFIX = r"^(?:gh[opsru]_|github_pat_|A[KS]IA[A-Z0-9]|[sr]k_live_|xox[abeprs]-|AIza|glpat-|npm_|hvs\.|dop_v1_)"
#: Words after a candidate, unless they name what follows them.
AFTER = r"(?i)^[^A-Za-z0-9\r\n]{0,6}(?:(?:is|was|as)\s+)?(?:(?:the|my|our|your|an?)\s+)?(?:%s)\w*+(?!\s*[\"']?\s*[=:])"
SECRET_AFTER = AFTER % "token|secret.key|secret|passw|api.?key|access.?key|bearer|credential|private.?key|client.?key|pwd"
DIGEST_AFTER = AFTER % "commit|sha-?\\d*|md5|checksum|digest|hash|uuid|guid|etag"
NEAR_DIGEST = r"(?i)(?<![a-z])(?:commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|etag|revision|integrity|example|placeholder|dummy|sample|base64|image|build|version|id)[^A-Za-z0-9]{0,6}$"
NAME = r"(?i:token|secret|passw|passwd|api.?key|access.?key|auth|bearer|credential|private.?key|client.?key|pwd)\w{0,30}"
#: Values of any characters, from four on, that are assigned to a name like a secret's: up to their quote, or else up to
#: white space and without closing punctuation.  The short look-behinds fail fast where nothing is assigned.
_NAMED = rf"(?<={NAME}[\"']?\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}%s)"
_VALUES = "|".join([_NAMED % '"' + r'[^\s"]{4,}(?=")', _NAMED % "'" + r"[^\s']{4,}(?=')", _NAMED % "" + r"(?!(?i:bearer|basic)\s)[^\s\"'<>=:][^\s\"'<>]{3,}(?<![.,;:!?)\]}])"])
ASSIGNED = rf"(?<=[:=>\s\"'])(?<=[:=]>?\s{{0,3}}[\"']?)(?:{_VALUES})"
PASSWORD_AT = rf"(?<={_LOGIN})[^\s/:@\"'<>]{{3,}}(?=@)"
PROPOSED = f"{PASSWORD_AT}|{ASSIGNED}|{CANDIDATE}"
#: What every text with a run, or with a named value, holds: most texts are done with after these.
HAS_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}"
HAS_NAMED = rf"[:=](?<={NAME}[\"']?\s{{0,3}}[:=])"
HAS_LOGIN = _LOGIN + r"[^\s/:@\"'<>]{3,}@"
HARMLESS_PATH = r"(?i)(?:^|[/_.-])(?:tests?|specs?|examples?|fixtures?|mocks?|samples?|demos?|docs?|vendor|lock)(?:[/_.-]|$)"

FEATURES = ("length", "class_changes", "letter_pairs", "dictionary", "digits", "distinct", "slashes", "harmless_path", "near_secret", "near_digest", "assigned", "known_prefix")


def proposed(text: Column) -> Column:
    """Array of (candidate, before, after): each candidate with the text up to the neighbouring candidates; null without any.
    Candidates are runs of at least 16 characters of keys and digests, whatever is assigned to a secret's name, and passwords
    in addresses."""

    def each(t: Column) -> Column:
        found, gaps = F.regexp_extract_all(t["text"], t["pattern"], F.lit(0)), F.split(t["text"], t["pattern"], -1)
        return F.arrays_zip(found.alias("candidate"), F.slice(gaps, 1, F.size(found)).alias("before"), F.slice(gaps, 2, F.size(found)).alias("after"))

    pattern = F.when(text.rlike(HAS_NAMED) | text.rlike(HAS_LOGIN), PROPOSED).when(text.rlike(HAS_RUN), CANDIDATE)
    one = F.transform(F.array(F.struct(text.alias("text"), pattern.alias("pattern"))), each)  # bound to a variable, so that texts are tested once
    return F.get(one, F.lit(0))


NEAR = 60  #: characters on either side that are searched for neighbouring words


def around(text: Column) -> Column:
    """Array of (candidate, before, after, left, right): as :func:`proposed`, with up to NEAR characters of the text on
    either side, neighbouring candidates included (two on each side)."""

    def piece(all_: Column, i: Column, side: str, name: str) -> Column:
        part = F.get(all_, i)[name]
        return F.coalesce(F.substring(part, -NEAR, NEAR) if side == "left" else F.substring(part, 1, NEAR), F.lit(""))

    def each(all_: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            left = F.concat(piece(all_, i - 2, "left", "candidate"), piece(all_, i - 1, "left", "before"), piece(all_, i - 1, "left", "candidate"), F.substring(c["before"], -NEAR, NEAR))
            right = F.concat(F.substring(c["after"], 1, NEAR), piece(all_, i + 1, "right", "candidate"), piece(all_, i + 1, "right", "after"), piece(all_, i + 2, "right", "candidate"))
            return F.struct(c["candidate"].alias("candidate"), c["before"].alias("before"), c["after"].alias("after"), F.substring(left, -NEAR, NEAR).alias("left"), F.substring(right, 1, NEAR).alias("right"))

        return F.transform(all_, one)

    return F.get(F.transform(F.array(proposed(text)), each), F.lit(0))  # bound to a variable, so that it is made once


def measured(c: Column, near: Column, after: Column, path: Column) -> list[Column]:
    """The FEATURES of a candidate with the text on both sides as doubles; a null path counts as an empty one."""
    n, low = F.length(c).cast("double"), F.lower(c)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / n
    values = [
        n,
        (F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / n,
        F.regexp_count(low, F.lit(f"(?=(?:{'|'.join(PAIRS)}))")) / n,
        1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        share("[^0-9]"),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        share("[^/]"),
        flag(path.rlike(HARMLESS_PATH)),
        flag(near.rlike(NEAR_SECRET) | after.rlike(SECRET_AFTER)),
        flag(near.rlike(NEAR_DIGEST) | after.rlike(DIGEST_AFTER)),
        flag(near.rlike(r"[=:]\s*[\"']?$")),
        flag(c.rlike(KNOWN_PREFIX)),
    ]
    return [v.cast("double").alias(name) for name, v in zip(FEATURES, values, strict=True)]


@dataclass(frozen=True)
class Forest:
    """Trees as nested (feature, threshold, at most, above) tuples over leaves 0 or 1."""

    trees: tuple

    def score(self, x: Column) -> Column:
        """Share of the trees that call the candidate with the features ``x`` (a struct) a secret."""

        def of(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, low, high = node
            return F.when(x[FEATURES[feature]] <= threshold, of(low)).otherwise(of(high))

        total = of(self.trees[0])
        for tree in self.trees[1:]:
            total = total + of(tree)
        return total / len(self.trees)


def parsed(debug: str) -> Forest:
    """The forest that Spark ML prints; only splits on numbers occur here."""
    trees = []
    for part in re.split(r"\n\s*Tree \d+ .*:\n", debug)[1:]:
        lines = iter([x.strip() for x in part.splitlines() if x.strip()])

        def node(lines=lines):
            line = next(lines)
            if m := re.match(r"Predict: ([\d.]+)", line):
                return float(m[1])
            m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
            low = node()
            next(lines)  # Else
            return int(m[1]), float(m[2]), low, node()

        trees.append(node())
    return Forest(tuple(trees))


#: Where findings come from, and what stands for a secret without being one.
LIVE_PATHS = "src/app.py|config/prod.yaml|deploy/values.yaml|.env|server/settings.ini|infra/main.tf|scripts/run.sh|src4|wiki/page|notes.txt|mail/inbox|web/index.php".split("|")
HARMLESS_PATHS = "tests/test_auth.py|examples/client.js|docs/setup.md|test/fixtures/keys.json|mocks/server.go|samples/demo.rb|vendor/lib/auth.c|spec/fixtures/a.yml|package-lock/npm|doc/api.rst".split("|")
PLACEHOLDERS = "changeme|your-api-key|your_token_here|xxxxxxxxxxxxxxxx|<password>|example-secret|insert-key-here|000000000000|None|null|required|optional|${TOKEN}|os.environ|not-a-real-key|abcdefghijklmnop".split("|")


class _Findings:
    """Draws labelled findings: a line of text around a value, its path, and whether the value is a secret."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def some(self, letters: str, least: int, most: int) -> str:
        return "".join(self.rng.choices(letters, k=self.rng.randint(least, most)))

    def word(self) -> str:
        return self.rng.choice(DICTIONARY)

    def prose(self, least: int = 0, most: int = 7) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(least, most)))

    def key(self) -> str:
        """A key, token or digest as machines make them."""
        rng = self.rng
        hexadecimal, alnum = "0123456789abcdef", string.ascii_letters + string.digits
        return rng.choice([
            lambda: self.some(hexadecimal, 32, 32),
            lambda: self.some(hexadecimal, 40, 40),
            lambda: self.some(hexadecimal, 64, 64),
            lambda: self.some(alnum, 16, 48),
            lambda: self.some(alnum + "-_", 20, 64),
            lambda: self.some(alnum + "+/", 24, 88) + rng.choice(["", "=", "=="]),
            lambda: self.some(string.ascii_uppercase + string.digits, 20, 32),
        ])()

    def password(self) -> str:
        """What people choose, or a machine makes in few characters."""
        rng = self.rng
        sign = lambda: rng.choice("-._$!@#%&*")
        return rng.choice([
            lambda: self.word() + str(rng.randint(1, 9999)) + sign(),
            lambda: self.word().capitalize() + sign() + str(rng.randint(1, 9999)),
            lambda: self.some(string.ascii_letters + string.digits, 8, 15),
            lambda: self.some(string.ascii_letters + string.digits, 3, 6) + sign() + self.some(string.ascii_letters + string.digits, 3, 6),
            lambda: self.word() + sign() + self.word() + str(rng.randint(10, 99)),
            lambda: self.some("0123456789abcdef", 10, 14),
        ])()

    def harmless(self) -> str:
        """What isn't random: names, paths, words run together, numbers."""
        rng, w = self.rng, self.word
        return rng.choice([
            lambda: "".join(w() for _ in range(rng.randint(3, 7))),
            lambda: "_".join(w() for _ in range(rng.randint(3, 6))),
            lambda: "-".join(w() for _ in range(rng.randint(3, 6))),
            lambda: w() + "".join(w().capitalize() for _ in range(rng.randint(2, 5))),
            lambda: "/" + "/".join(w() for _ in range(rng.randint(3, 6))),
            lambda: self.some("0123456789", 16, 24),
            lambda: "_".join(w().upper() for _ in range(rng.randint(3, 5))),
            lambda: rng.choice("=-_/+a0") * rng.randint(16, 60),
        ])()

    def uuid(self) -> str:
        return "-".join(self.some("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))

    def assigned(self, name: str, value: str) -> str:
        return self.rng.choice(['{n} = "{v}"', "{n} = '{v}'", "{n}={v}", "{n}: {v}", '"{n}": "{v}"', "{n}: '{v}'", "{n} := \"{v}\"", "export {n}={v}", "--{n}={v}"]).format(n=name, v=value)

    def name(self, kinds: str) -> str:
        rng = self.rng
        kind, before = rng.choice(kinds.split()), rng.choice(["", "", self.word() + "_", "db_", "aws_", "client_", "STRIPE_LIVE_"])
        made = before + kind
        return rng.choice([made, made.upper(), made.lower(), made.replace("_", "-")])

    def draw(self) -> tuple[str, str, float, str]:
        rng = self.rng
        names, sums = "token secret password passwd api_key access_key auth_token private_key client_key pwd secret_key api_token", "commit sha256 md5 checksum digest hash uuid etag revision integrity image build version"
        kind = rng.random()
        alnum = string.ascii_letters + string.digits
        if kind < 0.28:  # a key behind its name
            value, label = self.key(), 1
            text = self.assigned(self.name(names), value)
        elif kind < 0.42:  # a password behind its name
            value, label = self.password(), 1
            text = self.assigned(self.name("password passwd pwd secret db_password"), value)
        elif kind < 0.46:  # a password in an address
            value, label = self.password().replace("@", "-"), 1
            text = rng.choice(["{s}://{u}:{v}@{h}.host/{w}", "{s}://{u}:{v}@{h}:5432", 'url = "{s}://{u}:{v}@{h}/{w}"']).format(s=rng.choice("postgres mysql redis https amqp mongodb ftp".split()), u=self.word(), v=value, h=self.word(), w=self.word())
        elif kind < 0.51:  # in a sentence or a header
            value, label = self.key(), 1
            text = rng.choice(["{v} is the api key", "{v} is my token", "Authorization: Bearer {v}", "the access key {v}", "our api key is {v}", "the token was {v}", "secret key {v}", "use token {v}", "Bearer {v}", "auth {v}"]).format(v=value)
        elif kind < 0.58:  # keys that say so themselves
            begin, letters, n = rng.choice([("ghp_", alnum, 36), ("gho_", alnum, 36), ("AKIA", string.ascii_uppercase + string.digits, 16), ("sk_live_", alnum, 24), ("glpat-", alnum + "-_", 20), ("xoxb-", string.digits + "-" + alnum, 40), ("AIza", alnum + "-_", 35), ("npm_", alnum, 36)])
            value, label = begin + self.some(letters, n, n), 1
            text = rng.choice(["{v}", "key {v}", "({v})", "{v}.", "use {v} for it", "id {v}", "{w} = {v}", "{w}: '{v}'"]).format(v=value, w=self.word())
        elif kind < 0.69:  # digests behind theirs
            value, label = rng.choice([self.key, self.key, self.uuid])(), 0
            text = rng.choice([self.assigned(rng.choice(sums.split()), value), f"{rng.choice(sums.split())} {value}", f"{value} ({rng.choice(sums.split())})", f"{value} is the {rng.choice(sums.split())}", f"{rng.choice(sums.split())}:{value}"])
        elif kind < 0.73:  # digests and numbers on their own
            value, label = rng.choice([lambda: self.some("0123456789abcdef", 32, 32), lambda: self.some("0123456789abcdef", 40, 40), self.uuid, lambda: self.some("0123456789", 16, 20)])(), 0
            text = rng.choice(["{v}", "see {v}", "[{v}]", "id {v}"]).format(v=value)
        elif kind < 0.86:  # what isn't random
            value, label = self.harmless(), 0
            text = rng.choice([value, value, self.assigned(self.word(), value), self.assigned(self.name(names), value)])
        elif kind < 0.93:  # placeholders, calls and words behind a secret's name
            w = self.word
            value, label = rng.choice([rng.choice(PLACEHOLDERS), f"get_{w()}()", f"{w()}_{w()}", w() + w(), f"{w()}.{w()}_{w()}", w().capitalize() + w().capitalize()]), 0
            text = self.assigned(self.name(names + " auth author"), value)
        else:  # parts of pictures, styles and addresses
            value, label = self.some(string.ascii_letters + string.digits + "+/", 60, 200), 0
            text = rng.choice(["data:image/png;base64,{v}", "base64 {v}", 'src="image/{v}"']).format(v=value)
        path = rng.choice(LIVE_PATHS if rng.random() < (0.85 if label else 0.65) else HARMLESS_PATHS)  # tests and examples hold fewer secrets, but they hold some
        before, after = self.prose(), self.prose()
        line = f"{before} {text}{rng.choice(['', '', ' ', ',', ';', '.'])} {after}".strip() if rng.random() < 0.6 else text
        return line, path, float(label), value


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS, seed: int = 11) -> DataFrame:
    """(text, path, label, secret): made-up labelled findings, the same for the same arguments; ``secret`` is the part of
    the text that the label is about.  Secrets and digests are random, names and prose of dictionary words; of what stands in
    tests, examples and the like a smaller part is secret, so that a path is evidence and no verdict."""
    made = _Findings(seed)
    found = [dict(zip(("text", "path", "label", "secret"), made.draw())) for _ in range(rows)]
    each = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(found)), "array<struct<text string, path string, label double, secret string>>")).alias("f"))
    return each.select("f.*")


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7, rows: int = LABELLED_ROWS) -> Forest:
    """A forest for labelled findings (text, path, label, secret): of the candidates in a row's text, those that hold
    its ``secret`` or are a part of it have the row's label, and others are none; without that column or where it is
    null, all have the row's label.  Rows without a candidate or a label teach nothing; at most ``rows`` are read, chosen by a hash of the text."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    some = findings.where("label is not null").orderBy(F.xxhash64("text"), "text", "path").limit(rows)
    secret = F.col("secret") if "secret" in findings.columns else F.lit(None).cast("string")
    each = some.select("label", "path", secret.alias("secret"), F.explode(around(F.col("text"))).alias("c"))
    its = F.coalesce(F.col("c.candidate").contains(F.col("secret")) | F.col("secret").contains(F.col("c.candidate")), F.lit(True))
    each = each.select(F.when(its, F.col("label")).otherwise(0.0).alias("label"), *measured(F.col("c.candidate"), F.col("c.left"), F.col("c.right"), F.col("path")))
    points = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(written(each.coalesce(2), "findings"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", maxBins=64).fit(points)
    return parsed(model.toDebugString)


def judged(text: Column, path: Column, forest: Forest) -> Column:
    """Array of (candidate, before, after, score) of a text; null for a null text."""
    with_features = F.transform(around(text), lambda c: F.struct(c["candidate"].alias("candidate"), c["before"].alias("before"), c["after"].alias("after"), F.struct(*measured(c["candidate"], c["left"], c["right"], path)).alias("x")))
    return F.transform(with_features, lambda c: F.struct(c["candidate"].alias("candidate"), c["before"].alias("before"), c["after"].alias("after"), forest.score(c["x"]).alias("score")))


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", secret_from: float = SECRET_FROM) -> DataFrame:
    """(doc_id, ordinal, candidate, context, score, is_secret): a row for each candidate of every whole text.

    ``ordinal`` counts a text's candidates from 0 and ``context`` is the end of the text before one.  Null and
    empty texts have none; null ids and repeated rows are kept; other columns are not read.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(judged(F.col(text_col), path, forest)).alias("ordinal", "c"))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("c.candidate").alias("candidate"), F.substring("c.before", -40, 40).alias("context"), F.col("c.score").alias("score"), (F.col("c.score") >= secret_from).alias("is_secret"))


def redacted(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = "source", mark: str = "<secret>", secret_from: float = SECRET_FROM) -> DataFrame:
    """The same rows and columns, secrets in the text replaced by ``mark``; a null text stays null."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    found = docs.withColumn("_judged", judged(F.col(text_col), path, forest))
    pieces = F.transform("_judged", lambda c: F.concat(c["before"], F.when(c["score"] >= secret_from, F.lit(mark)).otherwise(c["candidate"])))
    clean = F.when(F.exists("_judged", lambda c: c["score"] >= secret_from), F.concat(F.array_join(pieces, ""), F.element_at("_judged", -1)["after"])).otherwise(F.col(text_col))
    return found.withColumn(text_col, clean).drop("_judged")
