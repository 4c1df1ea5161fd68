"""Spans against a plain linker in Python, on generated texts with planted credentials."""

import hashlib
import random
import re

from lakeaudit.llm import secretscan

from .test_operators import docs, words

BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
WEAK = {
    "identifier": re.compile(r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}|A(?:SIA|IDA|ROA|GPA)[A-Z0-9]{16}"""),
    "key": re.compile(r"(?<![A-Za-z0-9/+=_-])(?=[A-Za-z0-9/+]{0,39}[0-9])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[a-z])[A-Za-z0-9/+]{40}={0,2}(?![A-Za-z0-9/+=_-])"),
    "endpoint": re.compile(r"""(?i:https?|s3|ftp|jdbc:[a-z]+|amqps?|rediss?|mongodb(?:\+srv)?|postgres(?:ql)?|mysql)://[^\x20\t\r\n"'<>)\]]+"""),
}


def brute(text):
    base = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in p.finditer(text) if len(m[2] if k == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[k]]
    base.sort()
    weak = [(m.start(), 3 + i, k, m.end()) for i, (k, p) in enumerate(WEAK.items()) for m in p.finditer(text)]
    weak = [w for w in weak if not any(b[0] < w[3] and w[0] < b[3] for b in base)]
    every = base + weak
    apart = lambda a, b: a[3] <= b[0] or b[3] <= a[0]
    near = lambda a, b: abs(a[0] - b[0]) <= secretscan.SCOPE
    pairs = [(i, s) for i in every if i[2] in ("access", "identifier") for s in every if s[2] in ("assign", "hex", "key") and near(i, s) and apart(i, s)]
    hit = {x for p in pairs for x in p} | {e for e in weak if e[2] == "endpoint" and any(near(e, i) for i, _ in pairs)}
    return base, sorted({*base, *(x for x in hit if x[1] > 2)})


def text(r):
    key = lambda: "aA1" + "".join(r.choice("abcdefXYZ0189/+") for _ in range(37))
    parts = [
        lambda: f"client_id: user{r.randrange(999)}", lambda: "ASIA" + "".join(r.choice("AB12") for _ in range(16)), lambda: "AKIA" + "".join(r.choice("AB12") for _ in range(r.choice([12, 16, 20]))),
        key, lambda: f"secret = {key()}", lambda: "password:hunter22", lambda: "token=abc", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([20, 24, 64]))),
        lambda: f"https://host{r.randrange(9)}.example.test/p", lambda: "postgresql://db.example.test/x", lambda: "\U0001f600 été",
    ]
    out = []
    for _ in range(r.randrange(9)):
        out += [r.choice(parts)(), words(r.randrange(10**6), r.choice([1, 3, 30, 120]))]
    return r.choice([" ", "\n"]).join(out)


def named(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_links_against_brute_force(spark):
    r = random.Random(6)
    texts = [text(r) for _ in range(300)] + [None, "", *["login: me@x.example.test " + "ab1A" * 10] * 2, ("client_id: someone " + "ab1A" * 10 + " " + words(3, 60) + "\n") * 400]
    got = {x["doc_id"]: x for x in secretscan.digest(secretscan.scan(docs(spark, texts))).collect()}
    added = 0
    for i, t in enumerate(texts):
        base, found = brute(t or "")
        assert got[i]["spans"] == named(found), t
        assert got[i]["base_sha256"] == hashlib.sha256(named(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(b[2] == k for b in base) for k in BASE]
        added += len(found) - len(base)
    assert added > 800
