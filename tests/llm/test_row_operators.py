"""Quality rules, secrets, licences: results of single rows."""

import hashlib
import random
import re
import textwrap
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tonescale.llm import licenses, quality, secrets

SCHEMA = "doc_id long, text string, n_words string, fail_bits double, _text int"
ODD = [None, "", " \n\t ", "a", "ÄÖ ü\n\nÄÖ ü\n", "x " * 3000, "#$% a|b <c>"]


def table(spark, texts):
    rows = [(i, t, "clash", 1.5, i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None), rows[0], rows[0]], SCHEMA)


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(hit),
        len(re.findall("[0-9]", "".join(words))),
    )


def test_quality_against_brute_force(spark):
    rng = random.Random(3)
    texts = ODD[:5] + ["x " * 60, ODD[6]]
    for _ in range(60):
        words = [rng.choice("ab cd ef g1 h# é".split()) for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", "\n", "  "]) for w in words) * rng.choice([1, 1, 3]))
    got = quality.measure(table(spark, texts)).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        text = "null id" if r["doc_id"] is None else texts[r["doc_id"]]
        assert tuple(r[m] for m in quality.MEASURES) == measured(text), text


def test_policies_and_ablation_use_the_stored_bits(spark):
    texts = ["good " * 3, " ".join(f"word{i}" for i in range(30)), "a b " * 40, " ".join(["$$$ ab"] * 5 + [f"w{i}" for i in range(30)])]
    stored = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    bits = {r["doc_id"]: r["fail_bits"] for r in stored.collect()}
    assert bits[0] & 1 and bits[1] == 0 and bits[2] & 2
    kept = {r["doc_id"] for r in stored.filter(quality.kept("web@2")).collect()}
    assert kept == {i for i, b in bits.items() if b & quality.mask("web@2") == 0}
    assert stored.filter(quality.kept("base@1")).count() >= len(kept)
    table = {r["rule"]: r for r in quality.ablation(stored, "web@2").collect()}
    for rule in quality.RULES:
        bit, r = 1 << rule.bit, table[rule.name]
        assert r["n_failed"] == sum(b & bit != 0 for b in bits.values())
        assert r["n_only"] == sum(b == bit for b in bits.values())
        assert r["n_kept_without"] == r["n_kept"] + r["n_only"]


def test_quality_of_an_empty_table_and_whole_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.ledger(empty).count() == 0 and quality.passing(empty, "web@2").columns == empty.columns
    docs = table(spark, [None, " ".join(f"word{i}" for i in range(30))])
    assert [(r["doc_id"], r["n_words"]) for r in quality.passing(docs, "web@2").collect()] == [(1, "clash")]


def test_quality_plan_is_native(spark):
    plan = quality.ledger(table(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": (r"AKIA[A-Z0-9]+", 0),
    "hex": (r"[0-9a-f]+", 0),
}


def base_spans(text):
    found = []
    for k, (kind, (pattern, flags)) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", flags):
            long = {"assign": 12, "access": 18, "hex": 16}[kind]
            if len(m.group(2) if kind == "assign" else m.group()) >= long:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["password", "Token", "API_key", "apikey", " = ", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "0123abcdef", "deadbeef", " ", "\n", "é", "secret=", "x.y/z+", "="]
    texts = [None, "", "ſecret=abcdefghijklmnop"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    got = secrets.secret_digest(table(spark, texts)).filter("doc_id is not null").collect()
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in want) for k in BASE)
        assert set(want) <= set(r["spans"].split(",")) or not want


@pytest.mark.parametrize(
    "text, found",
    [
        ('DEFAULT = "hunter2!xyzQ9"\ndb.password = DEFAULT', ["hunter2!xyzQ9"]),
        ("a = 'Zx9-kk_1AbcD'\nb = a\nclient_secret => b", ["Zx9-kk_1AbcD"]),
        ("export API_KEY='abcd' + \"efgh1234ZZ\"", ["abcd", "efgh1234ZZ"]),
        ("x = y\ny = x\npassphrase = x", []),
        ("max_token_count = 123456789", []),
        ("password: changeme", []),
        ("the secret: nothing remarkable", []),
        ("password = getPassword(user1)", []),
        ("password = '${DB_PASSWORD}'", []),
        ('api_token: str = "Zx9-kk_1AbcD"', ["Zx9-kk_1AbcD"]),
        ("secret: Optional[str] = 'Zx9-kk_1AbcD'\nother: int = 5", ["Zx9-kk_1AbcD"]),
        ("pwd: dict[str, str] | None = 'Zx9-kk_1AbcD'", ["Zx9-kk_1AbcD"]),
        ("const password: string = 'Zx9-kk_1AbcD';", ["Zx9-kk_1AbcD"]),
        ("let password?: string = `Zx9-kk_1AbcD`;", ["Zx9-kk_1AbcD"]),
        ('var password string = "Zx9-kk_1AbcD"', ["Zx9-kk_1AbcD"]),
        ('var password []byte = "Zx9-kk_1AbcD"', ["Zx9-kk_1AbcD"]),
        ('const std::string password = "Zx9-kk_1AbcD";', ["Zx9-kk_1AbcD"]),
        ('let password: &str = "Zx9-kk_1AbcD";', ["Zx9-kk_1AbcD"]),
        ('password = ("Zx9-kk_1AbcD")', ["Zx9-kk_1AbcD"]),
        ('password = (\n  "Zx9-kk"\n  "_1AbcD"\n)', ["Zx9-kk", "_1AbcD"]),
        ('password = ( "Zx9-kk" +\n "_1AbcD")', ["Zx9-kk", "_1AbcD"]),
        ('part = "Zx9-kk_1AbcD"\npassword = (part)', ["Zx9-kk_1AbcD"]),
        ('password =\n    "Zx9-kk_1AbcD"', ["Zx9-kk_1AbcD"]),
        ('password = \\\n    "Zx9-kk_1AbcD"', ["Zx9-kk_1AbcD"]),
        ('passwords:\n  "name": "Zx9-kk_1AbcD"', []),
        ("password:\n  user_9: Zx9-kk_1AbcD", []),
        ('password = """Zx9-kk_1AbcD"""', ["Zx9-kk_1AbcD"]),
        ("password = \'\'\'Zx9-\nkk_1AbcD\'\'\'", ["Zx9-\nkk_1AbcD"]),
        ("password = b'Zx9-kk_1AbcD'\ntoken = r\"Zx9+kk_1AbcE\"", ["Zx9-kk_1AbcD", "Zx9+kk_1AbcE"]),
        ('config["password"] = "Zx9-kk_1AbcD"', ["Zx9-kk_1AbcD"]),
        ('body = "{\\"password\\": \\"Zx9-kk!1AbcD\\"}"', ["Zx9-kk!1AbcD"]),
        ("he said: \"it's in password = 'Zx9-kk_1AbcD', isn't it\"", ["Zx9-kk_1AbcD"]),
        ('password != "Zx9-kk_1AbcD"', []),
        ('password == "Zx9-kk_1AbcD"', []),
        ("url = db:password:Zx9!kk_1AbcD:5432", ["Zx9!kk_1AbcD"]),
        ("a = password = Zx9!kk_1AbcD", ["Zx9!kk_1AbcD"]),
        ("password: (see section 4.2b on page 17)", []),
        ("user" * 60 + "_password = 'Zx9-kk_1AbcD'", ["Zx9-kk_1AbcD"]),
        ("password = '" + "a" * 5000 + "Zx9-kk_1AbcD" * 3000 + "'", ["a" * 5000 + "Zx9-kk_1AbcD" * 3000]),
    ],
)
def test_assignments_are_followed(text, found):
    assert [text[s.value_start : s.value_end] for s in secrets.find(text) if s.kind == "literal"] == found


@pytest.mark.parametrize("part", ["a=", "password:", "password", "a:b+", "x:y[", "a:b<", '\\\\"', '"', "'", "`", '"""', "a=(", "token ", "(", "a.", "p=q ", '"a":', "b'", "var key "])
def test_the_lexer_is_linear_in_long_texts(part):
    started = time.monotonic()
    list(secrets.pairs(part * (200_000 // len(part))))
    secrets.lexed(part * (200_000 // len(part)))
    assert time.monotonic() - started < 20


def test_redaction_keeps_rows_columns_and_clean_texts(spark):
    docs = spark.createDataFrame(
        [(1, "token = 'abcdef123456789'", 25, "x"), (2, "clean text", 10, "y"), (3, None, None, None), (3, None, None, None)], "doc_id long, text string, n_chars long, spans string"
    )
    got = sorted(secrets.redact(docs).collect(), key=str)
    assert [r for r in got if r["doc_id"] == 2] == [r for r in docs.collect() if r["doc_id"] == 2]
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["text"] == "token = '[REDACTED]'" and one["n_chars"] == len(one["text"]) and len(got) == 4
    assert not secrets.find(one["text"])
    assert secrets.secret_digest(docs.limit(0)).count() == 0


def test_licences_by_canonical_digest(spark, monkeypatch):
    mit = licenses.KNOWN["mit"]
    texts = [
        None, "", "!!", mit, mit.replace("Software", "SOFTWARE,").replace("<year> <copyright holders>", "2001 Someone") + "\n\n", mit.replace("distribute", "share"),
        "Some text.\nAll Rights  reserved\nThis work is licenced under the GNU general public licence version 3\nmore",
    ]
    got = licenses.scan(table(spark, texts), licenses.known_licenses(spark)).collect()
    assert len(got) == len(texts) + 3
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["license_id"] for i in range(7)] == [None, None, None, "mit", "mit", None, None]
    assert by_id[6]["notices"] == ["notice:gpl-3.0", "notice:reserved"]
    assert by_id[0]["digest"] is None and by_id[3]["digest"] == by_id[4]["digest"]
    licence = {i: t for i, t in licenses.known_texts() if i in ("apache-2.0", "gpl-3.0")}
    whole = [
        "".join(f" * {x}\n" for x in licenses.KNOWN["bsd-3-clause"].replace("<year>, <owner>", "1999 Somebody").splitlines()),
        (Path(licenses.__file__).parent / "known" / "apache-2.0.txt").read_text(), licence["gpl-3.0"].upper(), licence["apache-2.0"][200:], "// SPDX-License-Identifier: GPL-2.0-only\nint x;",
    ]
    names = [k for k in licenses.KNOWN if ":" not in k]
    wrapped = [
        "\n\n".join(x if x.lower().startswith("copyright") else textwrap.fill(x, width) for x in licenses.KNOWN[k].split("\n\n"))
        for width in (50, 71, 72, 73, 74, 75, 76, 77, 78, 79, 80, 1000) for k in names
    ]
    got = licenses.scan(table(spark, wrapped), licenses.known_licenses(spark)).collect()
    assert all(r["license_id"] == names[r["doc_id"] % len(names)] for r in got if r["doc_id"] is not None)
    for most in (licenses.MOST_KNOWN, 1):
        monkeypatch.setattr(licenses, "MOST_KNOWN", most)
        got = {r["doc_id"]: r for r in licenses.scan(table(spark, whole), licenses.known_licenses(spark)).collect()}
        assert [got[i]["license_id"] for i in range(5)] == ["bsd-3-clause", "apache-2.0", "gpl-3.0", None, None]
        assert got[4]["notices"] == ["notice:gpl-2.0"]
    known = spark.createDataFrame([("b", "Same text"), ("a", "same  TEXT!"), ("e", None), (None, "x")], "license_id string, text string")
    assert [tuple(r)[1] for r in licenses.digests(known).collect()] == ["a"]
    assert licenses.scan(table(spark, ["a"]).limit(0), known).count() == 0
