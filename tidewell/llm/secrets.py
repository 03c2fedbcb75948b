"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are private key blocks, passwords in addresses, values that are assigned to a name
like `password`, and long runs of key-like characters. Their features are the candidate's length,
its character transitions (how much likelier each step from one character to the next is in
secrets than in look-alikes, by counts over the labelled findings), how much of it dictionary
words cover (the commonest words of all documents), whether it lies in a path, the path of the
document, and the words before and after it: how much likelier each word of these is beside secrets than
beside look-alikes is counted over the labelled findings too. The forest is fitted on
labelled findings with spark.ml and then written out as one SQL expression of nested conditions,
so that scanning is a projection: no shuffle, no Python, and a document's candidates stay with
the document.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import release, unused

# Patterns of candidates and of their surroundings.
_RUN = "[A-Za-z0-9+/_-]"
_BLOCK = "PRIVATE KEY(?: BLOCK)?-----"
_NAMED = "(?:passwor[dt]|passwd|pwd|kennwort|mot de passe|contrase[nñ]a|clave|secret[eo]?|geheimnis|token|jeton|credential|schl(?:ue|ü)ssel|api[ _-]?key|access[ _-]?key|auth)"
CANDIDATES = {
    # header lines may stand between the first mark and the key
    "block": rf"-----BEGIN [A-Z ]*?{_BLOCK}(?:\s*+[A-Za-z][A-Za-z-]*+:[^\n]*+\n)*+[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]*?{_BLOCK}",
    # the first lookbehind of each is there to be cheap
    "address": r"(?<=:)(?<=[a-z]://[^\s/:@]{0,255}:)[^\s/@\x22<>]{3,}+(?=@)",
    "assigned": rf"(?<=[:=][ \x22\x27`]{{0,3}})(?<=(?i:{_NAMED})[\x22\x27`]?[ ]{{0,2}}[:=][ \x22\x27`]{{0,3}})(?![ \x22\x27`])(?!-----)(?:[^\s\x22\x27`,;<>&]|&(?![A-Za-z_]++=)){{6,}}+",
    # a sign of equality belongs to a run only where no value follows it
    "run": rf"(?<!{_RUN})(?:(?=[A-Za-z+/_-]*+[0-9]){_RUN}{{12,}}+|{_RUN}{{20,}}+)(?:={{1,2}}+(?![^\s\x22\x27`,;:<>&)\]}}]))?+",
}
CANDIDATE = "|".join(CANDIDATES.values())
_KNOWN = "^(AKIA|ASIA|ghp_|gho_|ghs_|xox[abp]-|sk-|sk_live_|AIza|eyJ|glpat-|npm_|-----BEGIN)"
_NO_VALUE = "(?i)(^[$%{(\\[*]|[)}\\]]$|[(]|^(none|null|true|false|undefined)|environ|getenv|process[.]|self[.]|[*]{3})"
_SECRET_WORD = "(?i)(passw|pwd|kennwort|mot de passe|contrase|clave|geheim|jeton|schl(ue|ü)ssel|secret|token|api.?key|auth|credential|bearer|private.?key|access.?key)"
_HASH_WORD = "(?i)(commit|sha-?[0-9]*|md5|hash|checksum|digest|uuid|guid|revision|version|etag|build|blob|tree|file|page|ref|order|invoice|serial|session)"
_PLACEHOLDER = "(?i)(x{4,}|0{6,}|1234567|abcdefg|example|changeme|placeholder|your|sample|dummy|redacted|insert|test)"
_TEST_PATH = "(?i)(test|spec|example|sample|fixture|mock|doc|readme|demo|lock)"
#: Words of findings made by rule, and the dictionary where documents have no words.
_WORDS = (
    "account address admin after again always author back base before better black blue body book bottom build button "
    "call card case center change chapter check class clear client close code color column common config content copy "
    "count create daily data date default detail dialog digital direct display document down draft edit email empty "
    "engine error event every export field file final find first font footer form format front full function general "
    "green group handler head header help hidden high home house icon image import index inner input inside item "
    "join just language large last layer left length letter level light line link list local login long main manager "
    "master media member menu message method middle mobile model module month more music name native next node normal "
    "note number object offer online open option order other output over page panel parent part path people photo"
).split()
#: Words beside findings whose gains are held, and the least number of findings each stands beside.
BESIDE, BESIDE_LEAST = 150, 12
_LETTERS = "abcdefghijklmnopqrstuvwxyz0A-"
#: Most words of the learned dictionary.
DICTIONARY = 1000

FEATURES = (
    "length turns digits upper lower hex distinct dictionary transitions vowels secret_word assigned hash_word quoted "
    "slashes in_path test_path known uuid placeholder no_value address words_before words_after before_gain after_gain path_gain"
).split()


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with name standing for value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _steps(c: str) -> str:
    """SQL of the letters of c, each as its place in _LETTERS: capitals, digits and signs are one each."""
    plain = f"regexp_replace(regexp_replace(translate({c}, '123456789', '000000000'), '[A-Z]', 'A'), '[^a-zA0]', '-')"
    return f"transform(filter(split({plain}, ''), z -> z <> ''), z -> locate(z, '{_LETTERS}') - 1)"


def _beside(text: str) -> str:
    """SQL of the distinct words of a text beside a finding."""
    return f"array_distinct(regexp_extract_all(lower({text}), '[a-zà-ÿ]+', 0))"


def _gain(text: str, gains: dict[str, float]) -> str:
    """SQL of the sum of the gains of a text's words."""
    if not gains:
        return "0D"
    table = "map(" + ", ".join(f"{_q(w)}, {g!r}D" for w, g in gains.items()) + ")"
    return _let("m", table, f"aggregate({_beside(text)}, 0D, (t, w) -> t + coalesce(element_at(m, w), 0D))")


def _features(c: str, before: str, after: str, path: str, words: list[str], steps: list[float], beside: dict[str, dict[str, float]]) -> dict[str, str]:
    """SQL of each feature from SQL of the candidate and its surroundings; all double."""
    n = f"greatest(length({c}), 1)"
    known = "(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"
    near = f"right({before}, 40)"
    flag = lambda cond: f"if({cond}, 1D, 0D)"
    k = len(_LETTERS)
    gain = f"aggregate(sequence(0, greatest(size(a) - 2, 0)), 0D, (t, i) -> t + coalesce(get(s, get(a, i) * {k} + get(a, i + 1)), 0D))"
    table = f"array({', '.join(f'{x!r}D' for x in steps)})"
    return {
        "length": f"cast({n} as double)",
        "turns": f"regexp_count({c}, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+') / {n}",
        "digits": f"regexp_count({c}, '[0-9]') / {n}",
        "upper": f"regexp_count({c}, '[A-Z]') / {n}",
        "lower": f"regexp_count({c}, '[a-z]') / {n}",
        "hex": flag(f"{c} rlike '^([0-9a-f]+|[0-9A-F]+)$'"),
        "distinct": f"size(array_distinct(split({c}, ''))) / sqrt({n})",
        "dictionary": f"1 - length(regexp_replace(lower({c}), '{known}', '')) / {n}",
        "transitions": _let("s", table, _let("a", _steps(c), gain)) + f" / {n}",
        "vowels": f"regexp_count(lower({c}), '[aeiou]+') / {n}",
        "secret_word": flag(f"{near} rlike {_q(_SECRET_WORD)}"),
        "assigned": flag(f"{before} rlike {_q('[=:][ ]{0,2}[\"`]?$')} or {before} rlike {_q('[=:] ?.$')}"),
        "hash_word": flag(f"{near} rlike {_q(_HASH_WORD)}"),
        "quoted": flag(f"{before} rlike {_q('[\"`]$')} and {after} rlike {_q('^[\"`]')}"),
        "slashes": f"regexp_count({c}, '[/_-]') / {n}",
        "in_path": flag(f"{before} rlike {_q('[/.#@?&]$')} or {after} rlike {_q('^[/.@]?[.][A-Za-z]')}"),
        "test_path": flag(f"{path} rlike {_q(_TEST_PATH)}"),
        "known": flag(f"{c} rlike {_q(_KNOWN)}"),
        "uuid": flag(f"{c} rlike '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$'"),
        "placeholder": flag(f"{c} rlike {_q(_PLACEHOLDER)}"),
        "no_value": flag(f"{c} rlike {_q(_NO_VALUE)}"),
        "address": flag(f"{before} rlike {_q('://[^/@]*:$')} and {after} rlike '^@'"),
        "words_before": f"cast(regexp_count({before}, '[A-Za-z]+') as double)",
        "words_after": f"cast(regexp_count({after}, '[A-Za-z]+') as double)",
        "before_gain": _gain(near, beside.get("before", {})),
        "after_gain": _gain(after, beside.get("after", {})),
        "path_gain": _gain(path, beside.get("path", {})),
    }


def common_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> list[str]:
    """The `most` commonest words of 4 to 12 letters a-z over all documents; the fixed list if there are none."""
    words = docs.select(F.explode(F.expr(f"regexp_extract_all(lower(`{text_col}`), '(?<![a-z])[a-z]{{4,12}}(?![a-z])', 0)")).alias("w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()
    return [r.w for r in top] or _WORDS


def transition_gains(labelled: DataFrame) -> list[float]:
    """Log of how much likelier each step between two characters is in secrets than in others."""
    k = len(_LETTERS)
    steps = labelled.selectExpr("label", f"{_steps('candidate')} as a").selectExpr("label", "explode(transform(sequence(0, greatest(size(a) - 2, 0)), i -> get(a, i) * " + str(k) + " + get(a, i + 1))) as step")
    rows = steps.where("step is not null").groupBy("label", "step").count().collect()  # at most two for each step
    n = {y: [0.5] * (k * k) for y in (0, 1)}
    for r in rows:
        n[int(r.label > 0.5)][r.step] += r["count"]
    total = {y: sum(n[y]) for y in n}
    return [round(math.log(a / total[1]) - math.log(b / total[0]), 4) for a, b in zip(n[1], n[0], strict=True)]


def word_gains(labelled: DataFrame, text: str) -> dict[str, float]:
    """Log of how much likelier each word of `text` (SQL) is with secrets than with others: the BESIDE words that tell most."""
    rows = labelled.selectExpr("label", f"explode({_beside(text)}) as w").groupBy("w").agg(F.sum("label").alias("yes"), F.count("*").alias("n")).where(F.col("n") >= BESIDE_LEAST)
    yes, no = labelled.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    odds = F.log((F.col("yes") + 1) / ((yes or 0) + 2)) - F.log((F.col("n") - F.col("yes") + 1) / ((no or 0) + 2))
    top = rows.withColumn("gain", F.round(odds, 3)).orderBy(F.abs("gain").desc(), "w").limit(BESIDE).collect()
    return {r.w: r.gain for r in top}


def labelled_findings(spark: SparkSession, rows: int = 6000, words: list[str] | None = None) -> DataFrame:
    """candidate, before, after, path, is_secret, kind: findings made by rule, where no reviewed ones are given.

    Kinds of secrets and of look-alikes, each in several surroundings; the numbers come from
    hashes of the row number and the words from a dictionary, so every run gives the same rows.
    """
    # common words all over the list, as few as an expression should hold
    some = (words or _WORDS)[:: max(1, len(words or _WORDS) // 100)]
    every = "array(" + ", ".join(repr(w) for w in some) + ")"
    h = lambda salt: f"sha2(concat('{salt}', id), 256)"
    pick = lambda salt, *x: f"element_at(array({', '.join(x)}), cast(pmod(xxhash64('{salt}', id), {len(x)}) as int) + 1)"
    texts = lambda salt, *x: pick(salt, *(repr(t) for t in x))
    b32 = f"upper(translate(left({h('a')}, 16), '0189', 'XYZW'))"
    b64 = f"substr(base64(unhex({h('b')})), 1, 40)"
    mixed = f"replace(replace({b64}, '+', 'k'), '/', 'Q')"
    word = lambda i: f"element_at(ws, cast(pmod(xxhash64('w{i}', id), {len(some)}) as int) + 1)"
    say = lambda i: f"concat({word(i)}, ' ', {word(i + 1)}, ' ')"
    name = texts("n", "password", "token", "secret", "api_key", "apikey", "auth_token", "access_key", "client_secret", "passwd", "pwd", "Passwort", "Kennwort", "mot de passe", "contraseña", "clave", "secreto", "jeton")
    glue = texts("g", "=", " = ", ": ", '="', ' = "', '": "', " : ")
    named = f"concat({say(1)}, {name}, {glue})"
    short = pick(
        "s",
        f"concat(initcap({word(5)}), pmod(id, 97), substr('!#$%?', cast(pmod(id, 5) as int) + 1, 1))",
        f"concat(left({word(5)}, 3), left({h('i')}, 3), '!', upper(left({word(6)}, 2)), pmod(id, 13))",
        f"concat(translate({word(5)}, 'aeio', '4310'), left({h('j')}, 4))",
        f"left({mixed}, 6 + cast(pmod(xxhash64('m', id), 8) as int))",
        f"concat(left({b64}, 5), '@', left({h('k')}, 4), '%')",
        f"concat(reverse({word(5)}), pmod(id, 10), substr('!#$%?', cast(pmod(id, 5) as int) + 1, 1))",
        f"concat({word(5)}, pmod(id, 10), substr('!#$%?', cast(pmod(id, 5) as int) + 1, 1))",
    )
    parts = "array('en', 'tz', 'sch', 'ung', 'ver', 'ste', 'hen', 'lich', 'keit', 'ti', 'on', 'ment', 'ra', 'li', 'ta', 'or')"
    spoken = lambda n: f"array_join(transform(sequence(1, {n} + cast(pmod(id, 6) as int)), i -> element_at({parts}, cast(conv(substr({h('z')}, i, 1), 16, 10) as int) + 1)), '')"
    kinds = [
        ("access id", f"concat('AKIA', {b32})", say(1), say(3), 1),
        ("long hex", f"left({h('c')}, 40)", named, f"concat('\" ', {say(3)})", 1),
        ("hex", f"left({h('d')}, 16 + cast(pmod(xxhash64('l', id), 20) as int))", named, say(3), 1),
        ("base64", mixed, f"concat({name}, {glue})", f"concat('\"', {say(3)})", 1),
        ("known prefix", f"concat({texts('k', 'ghp_', 'sk_live_', 'xoxb-', 'AIza', 'glpat-')}, left({mixed}, 36))", say(1), say(3), 1),
        ("bearer", f"concat('eyJ', {b64})", "'Bearer '", say(3), 1),
        ("short password", short, named, f"concat({texts('q', '', '\"', ' ')}, {say(3)})", 1),
        ("address", short, f"concat({say(1)}, {texts('u', 'postgres', 'https', 'redis', 'mysql')}, '://', {word(7)}, ':')", f"concat('@', {word(8)}, '.host/')", 1),
        ("integrity", f"concat({texts('sr', 'sha512-', 'sha384-', 'sha256-', '')}, base64(unhex(concat({h('s1')}, {h('s2')}))))", f"concat({say(1)}, {texts('si', 'integrity ', 'integrity\x22: \x22', 'integrity=\x22', 'sha512 ', 'h1:')})", f"concat({texts('sj', '', '\x22')}, ' ', {say(3)})", 0),
        ("key id", f"left({h('t1')}, 40)", f"concat({say(1)}, {texts('ki', 'private_key_id\x22: \x22', 'key_id: ', 'fingerprint: ', 'key id ', 'thumbprint=', 'signature_id: ')})", f"concat('\x22 ', {say(3)})", 0),
        ("assigned name", f"concat(upper({word(5)}), '_', {texts('an', 'SECRET_ACCESS_KEY', 'CLIENT_SECRET', 'AUTH_TOKEN', 'PASSWORD_HASH', 'API_KEY_ID', 'CREDENTIALS_FILE', 'CONNECTION_STRING_2')})", f"concat({say(1)}, {texts('ao', '', 'export ', '$', '- ')})", f"concat({texts('ap', '=', ': ', ' = ', '')}, {mixed})", 0),
        ("key block", f"concat('-----BEGIN ', {texts('kb', 'RSA ', '', 'EC ', 'OPENSSH ')}, 'PRIVATE KEY-----\\n', repeat(concat(initcap({word(5)}), '-Info: ', {word(6)}, '\\n'), cast(pmod(xxhash64('kh', id), 24) - 8 as int)), '\\n', repeat(concat({b64}, '\\n'), 1 + cast(pmod(id, 9) as int)), '-----END PRIVATE KEY-----')", say(1), say(3), 1),
        ("commit", f"left({h('e')}, 40)", f"concat({say(1)}, {texts('c', 'commit ', 'sha1:', 'revision ', 'tree ', 'digest = ', 'checksum: ')})", say(3), 0),
        ("digest", h("f"), f"concat({say(1)}, {texts('d', 'sha256 ', 'sha256:', 'hash: ', 'etag \"')})", say(3), 0),
        ("uuid", f"concat_ws('-', substr({h('g')}, 1, 8), substr({h('g')}, 9, 4), substr({h('g')}, 13, 4), substr({h('g')}, 17, 4), substr({h('g')}, 21, 12))", f"concat({say(1)}, {texts('e', 'id=', 'uuid: ', 'session ', '')})", say(3), 0),
        ("path", f"concat({word(5)}, '_', {word(6)}, pmod(id, 1000), '-', {word(7)})", f"concat({say(1)}, {texts('f', '/', '', 'src/', 'name=', '')})", f"concat({texts('h', '.png', '', '/', ' ')}, {say(3)})", 0),
        ("long word", f"concat({word(5)}, {word(6)}, {word(7)}, {word(8)}, if(pmod(id, 3) = 0, cast(pmod(id, 100) as string), ''), {word(9)})", say(1), say(3), 0),
        ("unknown word", spoken(7), say(1), say(3), 0),
        ("placeholder", texts("p", "xxxxxxxxxxxxxxxxxxxx", "your_api_key_here_1", "EXAMPLEKEY1234567890", "00000000000000000000", "changeme_password_123", "20240131T235959000Z", "12345678901234567890", "example-token-value-1", "changeme", "********", "XXXXXXXX"), f"concat({say(1)}, if(pmod(id, 2) = 0, concat({name}, {glue}), ''))", say(3), 0),
        ("number", f"translate(substr({h('r')}, 1, 12 + cast(pmod(id, 7) as int)), 'abcdef', '174936')", f"concat({say(1)}, {texts('o', '', 'order ', 'number: ', 'phone ')})", say(3), 0),
        ("prose after name", pick("v", word(5), spoken(2), spoken(3), f"concat({word(5)}, '.')", f"concat({word(5)}, '_', {word(6)})", f"concat({word(5)}, {word(6)})"), f"concat({say(1)}, {name}, {texts('x', ': ', '=', ' = ', ': \"')})", f"concat(' ', {say(3)})", 0),
        ("unknown word after name", spoken(2), f"concat({say(1)}, {name}, {texts('x', ': ', '=', ' = ', ': \"')})", f"concat(' ', {say(3)})", 0),
        ("reference", pick("y", "concat('${', upper(" + word(5) + "), '}')", f"concat('os.environ[', {word(5)}, ']')", f"concat('get_', {word(5)}, '()')", f"concat('process.env.', upper({word(5)}))", f"concat('self.', {word(5)}, '_', {word(6)})", "'undefined'"), named, say(3), 0),
    ]
    cases = [f"when k = {i} then named_struct('candidate', cast({c} as string), 'before', {before}, 'after', {after}, 'is_secret', {y}D, 'kind', '{kind}')" for i, (kind, c, before, after, y) in enumerate(kinds)]
    secret = ", ".join(str(i) for i, kind in enumerate(kinds) if kind[4])
    path = (
        f"case when pmod(xxhash64('t', id), 2) = 0 then '' when k in ({secret}) then {texts('v1', 'config/prod.env', 'src/settings.py', 'deploy/values.yaml', 'app/main.py', 'tests/conftest.py', '.env')} "
        f"else {texts('v2', 'tests/fixtures/a.py', 'package-lock.json', 'docs/readme.md', 'app/main.py', 'src/settings.py', 'vendor/sum.lock')} end"
    )
    base = spark.range(rows).selectExpr("id", f"cast(pmod(id, {len(kinds)}) as int) as k", f"{every} as ws")
    return base.selectExpr(f"(case {' '.join(cases)} end) as f", f"{path} as path").select("f.*", "path")


def _parse(lines: list[str]) -> str:
    """One tree of a model's description as nested SQL conditions on x's features."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return f"{float(line.split(':')[1])}D"
    feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _parse(lines)
    lines.pop(0)  # the matching Else
    return f"if(x.{FEATURES[int(feature)]} <= {float(bound)!r}D, {low}, {_parse(lines)})"


@dataclass(frozen=True)
class Forest:
    """What scanning needs: the dictionary, the gains of transitions and of words beside, and SQL of the share of trees that say secret."""

    words: list[str]
    steps: list[float]
    trees: str
    beside: dict[str, dict[str, float]] = field(default_factory=dict)

    def features(self, c: str, before: str, after: str, path: str) -> str:
        """SQL of a candidate's features as a struct."""
        each = _features(c, before, after, path, self.words, self.steps, self.beside)
        return "named_struct(" + ", ".join(f"'{k}', cast({v} as double)" for k, v in each.items()) + ")"


def train_forest(labelled: DataFrame, words: list[str] | None = None, trees: int = 32, depth: int = 9, seed: int = 5) -> Forest:
    """Fit transitions and a forest on labelled findings: candidate, before, after, path, is_secret.

    Null texts count as empty; findings without a label are left out.
    """
    plain = labelled.selectExpr(*(f"coalesce({c}, '') as {c}" for c in ("candidate", "before", "after", "path")), "cast(is_secret as double) as label").where("label is not null")
    beside = {k: word_gains(plain, f"right({k}, 40)" if k == "before" else k) for k in ("before", "after", "path")}
    made = Forest(words or _WORDS, transition_gains(plain), "", beside)
    x = plain.selectExpr("label", f"{made.features('candidate', 'before', 'after', 'path')} as x").select("label", "x.*")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    out, at = [], []
    for line in model.toDebugString.splitlines()[1:]:
        if line.strip().startswith("Tree "):
            at = []
            out.append(at)
        elif line.strip():
            at.append(line)
    return Forest(made.words, made.steps, "(" + " + ".join(_parse(t) for t in out) + f") / {len(out)}", beside)


def default_forest(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> Forest:
    """A forest on findings made by rule, with the documents' own commonest words as the dictionary."""
    words = common_words(docs, text_col)
    forest = train_forest(labelled_findings(spark, words=words), words)
    release(spark)  # the fit runs through many plans
    return forest


def scan_secrets(
    spark: SparkSession,
    docs: DataFrame,
    forest: Forest | None = None,
    text_col: str = "text",
    path_col: str | None = None,
    threshold: float = 0.5,
    mask: str = "[SECRET]",
) -> DataFrame:
    """All columns of docs, with n_candidates, findings and redacted.

    findings: array<struct<start, length, secret, score>> of the secrets, start and length in
    code points of the original text; redacted: the text with each secret replaced by the mask.

    Defined cases: a null text stays null, with no findings; an empty one stays empty; equal
    rows get equal findings; texts of any length are read whole; an empty table gives no rows;
    columns of docs named like a result are replaced, others may have any name.
    """
    forest = forest or default_forest(spark, docs, text_col)
    path = f"coalesce(cast(`{path_col}` as string), '')" if path_col else "''"
    keep = [c for c in docs.columns if c not in ("n_candidates", "findings", "redacted")]
    rx = "r'" + CANDIDATE + "'"
    text = f"`{text_col}`"
    c, where, parts, x, score = (unused(docs, f"s_{k}") for k in ("c", "path", "parts", "x", "score"))
    none = "cast(array() as array<struct<start:bigint,length:bigint,secret:string,score:double>>)"
    own = [f"`{k}`" for k in docs.columns if k in keep or k == text_col]  # the text may have a result's name
    d = docs.selectExpr(*own, f"coalesce(regexp_extract_all({text}, {rx}, 0), cast(array() as array<string>)) as {c}", f"{path} as {where}")
    d = d.withColumn(parts, F.expr(f"if(size({c}) > 0, split({text}, {rx}, -1), cast(array() as array<string>))"))
    # a candidate with the text around it, up to its neighbours
    d = d.withColumn(x, F.expr(f"transform({c}, (c, i) -> named_struct('c', c, 'before', right({parts}[i], 64), 'after', left({parts}[i + 1], 32)))"))
    d = d.withColumn(x, F.expr(f"transform({x}, y -> {forest.features('y.c', 'y.before', 'y.after', where)})"))
    d = d.withColumn(score, F.expr(f"transform({x}, x -> {forest.trees})"))
    redacted = f"if(size({c}) > 0, array_join(transform({parts}, (p, i) -> concat(p, case when i >= size({c}) then '' when {score}[i] >= {threshold}D then '{mask}' else {c}[i] end)), ''), {text})"
    place = (
        f"aggregate(sequence(0, size({c}) - 1), named_struct('at', 0L, 'out', {none}), "
        f"(s, i) -> named_struct('at', s.at + length({parts}[i]) + length({c}[i]), 'out', "
        f"if({score}[i] >= {threshold}D, concat(s.out, array(named_struct('start', s.at + length({parts}[i]), 'length', cast(length({c}[i]) as bigint), 'secret', {c}[i], 'score', {score}[i]))), s.out)), s -> s.out)"
    )
    return d.selectExpr(
        *(f"`{k}`" for k in keep), f"cast(size({c}) as bigint) as n_candidates", f"if(exists({score}, v -> v >= {threshold}D), {place}, {none}) as findings", f"{redacted} as redacted"
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per whole document: candidates, secrets among them, where they are, and the redacted text's digest."""
    from ..sources.tables import table

    out = scan_secrets(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr(
        "doc_id", "n_candidates", "cast(size(findings) as bigint) as n_secrets",
        "sha2(array_join(transform(findings, f -> concat_ws(':', f.start, f.length, f.secret)), ','), 256) as findings_sha256",
        "sha2(coalesce(redacted, ''), 256) as redacted_sha256",
    )
