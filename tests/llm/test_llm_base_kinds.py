"""The base kinds of secrets and personal data against the contract's patterns, over all test documents and random texts."""

import hashlib
import random
import re

import pytest

from gustwatch.llm import registry

SF = "/root/testdata/sf0.001"
ANY = r"[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"""({ANY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(text):
    return [c for c in text if c in "0123456789"]


SECRETS = [
    ("assign", ASSIGN, lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m[0])) <= 15),
]


def plain(text, kinds):
    spans = [(m.start(), k, name, m.end()) for k, (name, pattern, holds) in enumerate(kinds) for m in pattern.finditer(text or "") if holds(m)]
    told = ",".join(f"{name}:{start}:{end}" for start, _, name, end in sorted(spans))
    counts = [sum(s[2] == name for s in spans) for name, _, _ in kinds]
    return (*counts, hashlib.sha256(told.encode()).hexdigest())


def noisy(n):
    """Texts whose parts sit close to the patterns' edges."""
    pick = random.Random(11)
    parts = ["password", "PassWD", "api_key", "APIKEY", "secret", "token", ":", "=", " ", "  ", '"', "'", "abcdefgh", "a1B2c3D4", "AKIA", "AKIAABCDEFGH1234", "x",
             "0123456789abcdef", "deadbeef" * 4, "a@b.c", "joe.doe+x@mail.example.org", "@", ".", "..", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "0" * 15, "+49 (30) 123-4567", "+1", "+12345678901", "-", "ä", "😀", "\n", "7"]
    return ["".join(pick.choices(parts, k=pick.randrange(1, 25))) for _ in range(n)] + ["", None]


@pytest.mark.parametrize(("name", "kinds"), [("op2_secret_scan", SECRETS), ("op4_disclosing_terms", PERSONAL)])
def test_base_kinds(spark, tmp_path, name, kinds):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.agg({"doc_id": "max"}).first()[0] + 1
    more = [(first + i, t, "en", "noise", len(t or "")) for i, t in enumerate(noisy(400))]
    docs.unionByName(spark.createDataFrame(more, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()}
    columns = [f"n_{k}" for k, _, _ in kinds]
    found = registry.queries()[name](spark, str(tmp_path)).select("doc_id", *columns, "base_sha256").collect()
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r)[1:] == plain(texts[r["doc_id"]], kinds), texts[r["doc_id"]]
