"""Secret scan: pattern candidates, false positives removed by a random forest.

Everything runs as DataFrame expressions.  One regular expression finds candidates;
cutting the text by the same expression gives the words around each.  A candidate's
features are its length, its character transitions (turns of character classes, and
letter pairs that are likely or unlikely by the dictionary's own counts), how much of it
dictionary words cover, and what the path and the neighbouring words say.  The forest is
trained by Spark's own trainer on labelled findings and then written out as SQL
conditions, so a text's candidates are judged, and its secrets blanked, inside its own
row: no shuffle, no join, no key that could be hot.

The dictionary is the words and word ends of a public tokenizer's vocabulary file,
``WORDS`` at most, in the file's order, which is that of their frequency; it becomes one
regular expression in the shape of a trie, which takes the longest word at each place.

:func:`labelled_findings` makes the shipped training set by rule, ``FINDINGS`` rows of
known kinds: keys as services issue them, and what scanners often mistake for them
(commit ids, checksums, identifiers, placeholders, paths, long words, embedded data).
Any other table (value, lead, left, right, path, label) will do as well.

Defined cases: a null or empty text has no candidates and stays as it is (null stays
null); a null path counts as empty; rows that repeat a doc_id, or have none, are scanned
each on its own; a candidate with votes for exactly the share asked is a secret; an empty
table gives no rows; texts of any length are scanned whole, and no feature makes an array
of a candidate's characters; columns of ``docs`` travel inside ``row``, so that no name
can clash.  A private key is one candidate from its first line to its last, if at most
``KEY_LENGTH`` characters lie between; otherwise its lines are judged each by itself.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = 6000
TREES, DEPTH, SEED = 25, 8, 11
VOTES = 0.5
MASK = "[SECRET]"

# Words that announce a secret, and words beside things that look like one.
ASKING = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private"]
INNOCENT = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "revision", "integrity", "etag", "build", "id"]
PLACEHOLDERS = ["example", "changeme", "placeholder", "your", "dummy", "sample", "xxxx", "test", "insert", "redacted", "1234567890", "abcdef"]
TEST_PATHS = ["test", "example", "sample", "fixture", "mock", "docs", "spec", "demo"]
WORDS = 6000
KEY_LENGTH = 8000

#: What may stand before a value: a name that ends in a keyword, sign and quote.
LEAD = r"""(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{0,48}?(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[A-Za-z0-9_-]{0,24}["']?\s{0,3}[:=]{1,2}\s{0,3}["']?"""
CANDIDATE = (
    rf"""{LEAD}[^\s"']{{6,}}"""
    rf"""|-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]{{0,{KEY_LENGTH}}}-----END [A-Z ]{{0,20}}PRIVATE KEY-----)?"""
    r"""|[A-Za-z0-9+/_=-]{20,}"""
)

_V, _L, _R, _P = "c.value", "lower(c.`left`)", "lower(c.`right`)", "lower(c.path)"


def _sql(pattern: str) -> str:
    """A regular expression as a SQL literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _share(pattern: str, of: str = _V) -> str:
    return f"regexp_count({of}, {_sql(pattern)}) / greatest(length({of}), 1)"


def _says(words: list[str], where: str) -> str:
    return f"cast(regexp_like({where}, {_sql('|'.join(map(re.escape, words)))}) as double)"


def trie_pattern(words: Iterable[str]) -> str:
    """A regular expression that matches the longest of ``words`` at a place."""
    trie: dict = {}
    for word in words:
        node = trie
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [re.escape(c) + written(below) for c, below in sorted(node.items()) if c]
        if not branches:
            return ""
        inner = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return f"{inner}?" if "" in node else inner

    return written(trie)


@dataclass(frozen=True)
class Lexicon:
    """A dictionary and the letter pairs that are likely, or unlikely, in its words."""

    words: tuple[str, ...]
    likely: frozenset[str]
    unlikely: frozenset[str]

    @classmethod
    def of(cls, words: Iterable[str]) -> Lexicon:
        """The pairs that make up four fifths of all are likely, those of the last hundredth, or never seen, are not."""
        own = tuple(dict.fromkeys(words))
        letters = "abcdefghijklmnopqrstuvwxyz"
        seen = Counter(w[k : k + 2] for w in own for k in range(len(w) - 1))
        total, held, likely, unlikely = sum(seen.values()), 0, set(), {a + b for a in letters for b in letters} - set(seen)
        for pair, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
            (likely if held < 0.8 * total else unlikely if held >= 0.99 * total else set()).add(pair)
            held += n
        return cls(own, frozenset(likely), frozenset(unlikely))

    def pairs(self, which: frozenset[str]) -> str:
        """A regular expression that matches the first letter of each of these pairs."""
        first: dict[str, str] = {}
        for pair in sorted(which):
            first[pair[0]] = first.get(pair[0], "") + pair[1]
        return "|".join(f"{a}(?=[{b}])" for a, b in first.items())


def vocabulary(path: str, most: int = WORDS) -> Lexicon:
    """The dictionary of a tokenizer file's words and word ends of four letters or more, in the file's order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    ranked = sorted((i, t) for t, i in model["vocab"].items() if t.endswith(end))
    words = [t[: -len(end)] for _, t in ranked]
    return Lexicon.of([w for w in words if re.fullmatch("[a-z]{4,}", w)][:most])


def features(lexicon: Lexicon) -> dict[str, str]:
    """Name and SQL of each feature over a candidate ``c(value, lead, left, right, path)``."""
    letters = f"greatest(regexp_count(lower({_V}), {_sql('[a-z](?=[a-z])')}), 1)"
    alphabet = [chr(c) for c in range(33, 127) if chr(c) not in "'\\"]
    return {
        "size": f"cast(least(length({_V}), 200) as double)",
        "digits": _share("[0-9]"),
        "capitals": _share("[A-Z]"),
        "smalls": _share("[a-z]"),
        "marks": _share("[^A-Za-z0-9]"),
        "hex": f"cast(regexp_like({_V}, {_sql('^[0-9a-fA-F]+$')}) as double)",
        "known_prefix": f"cast(regexp_like({_V}, {_sql('^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|glpat-|npm_|-----BEGIN)')}) as double)",
        "to_digit": _share("[A-Za-z](?=[0-9])"),
        "from_digit": _share("[0-9](?=[A-Za-z])"),
        "to_capital": _share("[a-z](?=[A-Z])"),
        "vowel_turns": _share("[aeiouAEIOU](?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"),
        "same_twice": _share(r"(.)(?=\1)"),
        "likely_pairs": f"regexp_count(lower({_V}), {_sql(lexicon.pairs(lexicon.likely))}) / {letters}",
        "unlikely_pairs": f"regexp_count(lower({_V}), {_sql(lexicon.pairs(lexicon.unlikely))}) / {letters}",
        "distinct": f"({' + '.join(f'cast(instr({_V}, {_sql(c)}) > 0 as int)' for c in alphabet)}) / greatest(length({_V}), 1)",
        "dictionary": f"1 - length(regexp_replace(lower({_V}), {_sql(trie_pattern(lexicon.words))}, '')) / greatest(length({_V}), 1)",
        "parts": f"cast(regexp_count({_V}, {_sql('[-_/+=.]')}) as double)",
        "placeholder": _says(PLACEHOLDERS, f"lower({_V})"),
        "lead": "cast(length(c.lead) > 0 as double)",
        "asking_left": _says(ASKING, _L),
        "innocent_left": _says(INNOCENT, _L),
        "quoted": f"cast(regexp_like(c.`right`, {_sql(chr(94) + '[' + chr(34) + chr(39) + ']')}) as double)",
        "test_path": _says(TEST_PATHS, _P),
        "test_words": f"greatest({_says(TEST_PATHS, _L)}, {_says(TEST_PATHS, _R)})",
    }


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """(value, left, right, path, label): findings of known kinds, made by rule from row numbers."""
    base = spark.range(rows, numPartitions=1).selectExpr(
        "id", "sha2(cast(id as string), 256) as h", "base64(unhex(sha2(concat('b', id), 256))) as b64",
        "pmod(xxhash64(id), 24) as kind", "pmod(xxhash64(id, 'x'), 4) as turn",
    )
    asked = "element_at(array('token = \"', 'api_key: ', 'secret=', 'password = \"'), cast(turn + 1 as int))"
    named = "element_at(array('DB_PASSWORD=', 'AWS_SECRET_ACCESS_KEY=', 'SERVICE_API_KEY=', 'export APP_TOKEN_V2='), cast(turn + 1 as int))"
    words = "concat_ws('', transform(sequence(1, 3 + cast(turn as int)), k -> element_at(array({}), cast(pmod(xxhash64(id, k), {}) + 1 as int))))"
    parts = ["user", "Manager", "Config", "Service", "handler", "Factory", "th", "ation", "eau", "heit", "lich", "the", "ment", "er", "ou", "in"]
    word = words.format(", ".join(f"'{p}'" for p in parts), len(parts))
    kinds = {
        0: ("substr(h, 1, 40)", asked, "'\" '", "'src/app.py'", 1),
        1: ("concat('AKIA', upper(substr(h, 1, 16)))", "'key '", "' '", "'conf/aws.ini'", 1),
        2: ("concat('ghp_', substr(regexp_replace(b64, '[+/=]', 'a'), 1, 36))", "'use '", "' '", "'ci.yml'", 1),
        3: ("substr(b64, 1, 32)", asked, "'\"'", "'settings.json'", 1),
        4: ("substr(b64, 1, 12)", asked, "'\"'", "'settings.py'", 1),
        5: ("substr(h, 1, 32)", asked, "'\"\\n'", "'env'", 1),
        6: ("concat('eyJ', substr(regexp_replace(b64, '[+/=]', 'x'), 1, 40))", "'bearer '", "' '", "'log.txt'", 1),
        7: ("substr(h, 1, 40)", "element_at(array('commit ', 'sha1 ', 'revision ', 'build '), cast(turn + 1 as int))", "' '", "'CHANGES'", 0),
        8: ("h", "element_at(array('sha256:', 'checksum ', 'digest ', 'integrity '), cast(turn + 1 as int))", "' '", "'lock.json'", 0),
        9: ("concat_ws('-', substr(h,1,8), substr(h,9,4), substr(h,13,4), substr(h,17,4), substr(h,21,12))", "'uuid '", "' '", "'db.sql'", 0),
        10: (f"concat({word}, {word})", "'call '", "' '", "'src/main.java'", 0),
        11: (f"lower(concat({word}, {word}))", "' und '", "' der '", "''", 0),
        12: ("element_at(array('your_api_key_goes_here_please', 'xxxxxxxxxxxxxxxxxxxxxxxx', 'changeme_changeme', 'example-secret-value-1234'), cast(turn + 1 as int))", asked, "'\"'", "'docs/readme'", 0),
        13: (f"concat('usr/', {word}, '/', {word}, '/', {word})", "'in '", "' '", "'notes'", 0),
        14: ("repeat(element_at(array('=', '-', '_', 'ab'), cast(turn + 1 as int)), 24)", "'line '", "' '", "'page'", 0),
        15: ("substr(h, 1, 40)", asked, "'\"'", "'tests/fixtures/sample.py'", 0),
        16: ("substr(b64, 1, 24 + 4 * cast(turn as int))", named, "'\\n'", "'.env'", 1),
        17: (f"concat({word}, cast(pmod(xxhash64(id, 'n'), 9000) as string), '!')", named, "'\\n'", "'.env'", 1),
        18: ("concat('-----BEGIN RSA PRIVATE KEY-----\\n', b64, '\\n', b64, '\\n-----END RSA PRIVATE KEY-----')", "'key:\\n'", "'\\n'", "'id_rsa'", 1),
        19: ("element_at(array(concat('sk_live_', substr(h, 1, 24)), concat('xoxb-', substr(h, 1, 12), '-', substr(h, 13, 24)), concat('AIza', substr(regexp_replace(b64, '[+/=]', '-'), 1, 35)), concat('glpat-', substr(regexp_replace(b64, '[+/=]', '_'), 1, 20))), cast(turn + 1 as int))", "'use '", "'\\n'", "'notes'", 1),
        20: ("concat(b64, b64, b64)", "'src=data:image/png;base64,'", "'\"'", "'page.html'", 0),
        21: ("concat(element_at(array('sha256-', 'sha512-', 'sha1-', 'sha384-'), cast(turn + 1 as int)), b64)", "'\"integrity\": \"'", "'\"'", "'package-lock.json'", 0),
        22: (f"concat({word}, '_', {word}, '_', {word})", "'def '", "'(self'", "'src/a.py'", 0),
        23: (f"concat('get', {word}, 'From', {word})", asked, "'('", "'src/b.js'", 0),
    }
    pick = lambda i: "case kind " + " ".join(f"when {k} then {v[i]}" for k, v in kinds.items()) + " end"
    return base.selectExpr(
        f"{pick(0)} as value", f"{pick(1)} as full_left", f"{pick(2)} as `right`", f"{pick(3)} as path", f"cast({pick(4)} as double) as label"
    ).selectExpr("value", f"regexp_extract(full_left, {_sql('(?i)' + LEAD + '$')}, 0) as lead", "full_left as `left`", "`right`", "path", "label")


def train(findings: DataFrame, lexicon: Lexicon, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A random forest over the features of labelled findings (value, lead, left, right, path, label)."""
    shaped = findings.selectExpr("struct(value, lead, `left`, `right`, path) as c", "label")
    known = shaped.selectExpr("label", *[f"{sql} as {name}" for name, sql in features(lexicon).items()])
    rows = VectorAssembler(inputCols=list(features(lexicon)), outputCol="features").transform(known).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2).fit(rows)


@dataclass
class Scanner:
    """A trained forest with the dictionary that its features ask."""

    model: RandomForestClassificationModel
    lexicon: Lexicon
    votes: float = VOTES

    @classmethod
    def trained(cls, spark: SparkSession, dictionary: str) -> Scanner:
        """On the shipped findings, with the dictionary of a tokenizer file."""
        lexicon = vocabulary(dictionary)
        return cls(train(labelled_findings(spark), lexicon), lexicon)


def forest_sql(model: RandomForestClassificationModel) -> str:
    """The share of trees that vote for a secret, as SQL over a feature struct ``f``."""
    names = list(features(Lexicon.of([])))

    def tree(lines: list[str]) -> str:
        head = lines[0].strip()
        if head.startswith("Predict"):
            return str(int(float(head.split(":")[1])))
        depth = len(lines[0]) - len(lines[0].lstrip())
        turn = next(i for i, x in enumerate(lines[1:], 1) if len(x) - len(x.lstrip()) == depth)
        feature, bound = re.search(r"feature (\d+) <= ([-0-9.eE]+)", head).groups()
        return f"if(f.{names[int(feature)]} <= {float(bound)!r}D, {tree(lines[1:turn])}, {tree(lines[turn + 1 :])})"

    votes = [tree(t.toDebugString.rstrip().split("\n")[1:]) for t in model.trees]
    return f"({' + '.join(votes)}) / {len(votes)}"


def find_secrets(docs: DataFrame, scanner: Scanner, path: str | None = None) -> DataFrame:
    """(row, found, clean) of every row of ``docs``: the row itself, its candidates (value, lead, left, right, path,
    score, secret), and its text with secrets masked."""
    lead = _sql("(?i)^" + LEAD)
    pattern = _sql("(?i)" + CANDIDATE)
    where = F.coalesce(docs[path].cast("string"), F.lit("")) if path else F.lit("")
    base = docs.select(F.struct("*").alias("row"), docs["text"].cast("string").alias("text"), where.alias("path"))
    hit = base.withColumn("hit", F.expr(f"coalesce(regexp_like(`text`, {pattern}), false)"))
    cut = hit.selectExpr(
        "*", f"if(hit, regexp_extract_all(`text`, {pattern}, 0), array()) as raw", f"if(hit, split(`text`, {pattern}), array()) as rest"
    )
    around = cut.withColumn("seen", F.expr(f"""
        transform(raw, (x, i) -> named_struct(
            'value', regexp_replace(x, {lead}, ''), 'lead', regexp_extract(x, {lead}, 0),
            'left', concat(right(get(rest, i), 40), regexp_extract(x, {lead}, 0)),
            'right', left(get(rest, i + 1), 20), 'path', path))"""))  # fmt: skip
    fields = ", ".join(f"'{name}', {sql}" for name, sql in features(scanner.lexicon).items())
    measured = around.withColumn("features", F.expr(f"transform(seen, c -> named_struct({fields}))"))
    scored = measured.withColumn("scores", F.expr(f"transform(features, f -> {forest_sql(scanner.model)})"))
    found = scored.withColumn("found", F.expr(f"""
        transform(seen, (c, i) -> named_struct('value', c.value, 'lead', c.lead, 'left', c.`left`, 'right', c.`right`,
            'path', c.path, 'score', cast(get(scores, i) as double), 'secret', get(scores, i) >= {scanner.votes}D))"""))  # fmt: skip
    masked = F.expr(f"""
        if(exists(found, c -> c.secret), array_join(concat(array(get(rest, 0)), transform(found, (c, i) ->
            concat(if(c.secret, concat(c.lead, '{MASK}'), get(raw, i)), get(rest, i + 1)))), ''), `text`)""")  # fmt: skip
    return found.select("row", "found", masked.alias("clean"))


def scan_secrets(docs: DataFrame, scanner: Scanner, path: str | None = "source") -> DataFrame:
    """(doc_id, n_candidates, n_secrets, max_score, secrets, clean_sha256) of every document."""
    own = docs.select("doc_id", "text", *[c for c in docs.columns if c == path])
    found = find_secrets(own, scanner, path if path in docs.columns else None)
    return found.selectExpr(
        "cast(`row`.doc_id as long) as doc_id", "cast(size(found) as long) as n_candidates",
        "cast(size(filter(found, c -> c.secret)) as long) as n_secrets",
        "coalesce(array_max(transform(found, c -> c.score)), 0D) as max_score",
        "transform(filter(found, c -> c.secret), c -> sha2(c.value, 256)) as secrets",
        "sha2(coalesce(clean, ''), 256) as clean_sha256",
    )
