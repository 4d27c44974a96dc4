"""The secret scan against a scan of its own kind, and on very long texts."""

import hashlib
import time

import duckdb
import pytest

from footfall.llm import secrets
from footfall.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
LOWER, WORD = set("0123456789abcdef"), set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
CAPITALS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def run(text, i, allowed):
    j = i
    while j < len(text) and text[j] in allowed:
        j += 1
    return j


def assignment(text, i):
    """(end, length of the value) of an assignment that begins at i, letter by letter."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[i:i + 8])
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        if low.startswith(word):
            j = i + len(word)
            j += text[j:j + 1] in ("'", '"') and len(text[j:j + 1])
            while text[j:j + 1] == " ":
                j += 1
            if text[j:j + 1] not in (":", "="):
                continue
            j += 1
            while text[j:j + 1] == " ":
                j += 1
            j += text[j:j + 1] in ("'", '"') and len(text[j:j + 1])
            end = run(text, j, WORD)
            if end > j:
                return end, end - j
    return None


def by_hand(text):
    found, i = [], 0
    while i < len(text):
        hit = assignment(text, i) if text[i] in "psatPSAT" else None
        if hit:
            found += [(i, 0, hit[0])] if hit[1] >= 6 else []
            i = hit[0]
        else:
            i += 1
    i = 0
    while (i := text.find("AKIA", i)) >= 0:
        end = run(text, i, CAPITALS)
        found += [(i, 1, end)] if end - i >= 20 else []
        i = end
    i = 0
    while i < len(text):
        end = run(text, i, LOWER)
        found += [(i, 2, end)] if end - i >= 24 else []
        i = max(end, i + 1)
    return sorted(found)


def test_base_spans_and_digest_of_the_given_documents(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall())
    kinds = ["assign", "access", "hex"]
    seen = 0
    for r in QUERIES["op6_secret_scan"](spark, FOLDER).collect():
        base = by_hand(texts[r["doc_id"]])
        seen += len(base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        listed = [f"{kinds[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(","))
    assert seen


@pytest.mark.parametrize("text", [
    "my token is fine and " * 240_000, "token " * 800_000, "secret" * 800_000, "token Ab1" + "x" * 20 + " \n" * 1_000_000,
    ("token=abc123def " * 100_000), "token " + "aB3" * 1_000_000, "password: " * 300_000])
def test_long_texts_take_linear_time(text):
    novelty = secrets.Novelty()
    start = time.perf_counter()
    secrets.scan(text, novelty)
    assert time.perf_counter() - start < 10


def test_long_runs_are_covered_by_their_parts():
    import random

    r = random.Random(1)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    text = "key: token " + noise(3000) + "_token_" + noise(3000) + " end"
    spans = secrets.scan(text, secrets.Novelty())[1]
    assert sum(e - s for s, _, e in spans) >= 5990
