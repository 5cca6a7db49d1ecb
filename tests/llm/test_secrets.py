import hashlib
import random
import re

from plenum.llm import secrets
from plenum.llm.queries import OP1_SQL  # noqa: F401  (the SQL runs in test_queries)

BASE = {
    "assign": re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile("(AKIA[A-Z0-9]+)"),
    "hex": re.compile("([0-9a-f]+)"),
}
LEAST = {"assign": 12, "access": 18, "hex": 16}


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[m.lastindex]) >= LEAST[kind]]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def scanned(docs):
    return [(r["doc_id"], r["spans"]) for r in docs.collect()] if "spans" in docs.columns else None


def strong(spans):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["strong"]]


def test_base_spans_as_by_python(spark, documents):
    rng = random.Random(5)
    pieces = ["token", "Password", "API_KEY", "apikey", "passwd", "=", ":", " ", '"', "'", "==", "AKIA", "AKIAAKIA", "0123456789abcdef", "abcdefabcdef", "é", "😀", "XYZ0123456789QW",
              "secret", "\n", "-._=+/", "ſecret", "toKen"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    docs = documents(*enumerate(texts))
    for doc_id, spans in scanned(secrets.scan(docs)):
        assert strong(spans) == base_spans(texts[doc_id]), texts[doc_id]


def test_weak_parts_need_their_complement(documents):
    blob = "wJalrXUtnFEMIxK7MDENGxbPxRfiCYEXAMPLEKEY"
    far = "lorem " * 100
    docs = documents((1, f"user: bob {blob}"), (2, f"{blob} alone"), (3, f"user: bob {far} {blob}"), (4, f"user=ann password=abc123 https://db.example.com/x"),
                     (5, "see https://example.com/page"), (6, "user: bob said hello"), (7, f"token = 0123456789abcdefXYZ user=ann"))
    kinds = {i: [s["kind"] for s in spans] for i, spans in scanned(secrets.scan(docs))}
    assert kinds == {1: ["user", "blob"], 2: [], 3: [], 4: ["user", "assign", "endpoint"], 5: [], 6: [], 7: ["assign", "hex", "user"]}


def test_scopes_agree_with_all_pairs(documents):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        parts = [rng.choice(["user=bob1 ", "password=abcd ", "https://x.example/ ", "AKIA0123456789 ", "z" * rng.randint(1, 300) + " "]) for _ in range(rng.randint(1, 14))]
        texts.append("".join(parts))
    found = dict(scanned(secrets.scan(documents(*enumerate(texts)), reach=120)))
    single = {k: re.compile(p) for k, (p, _, _) in secrets.PATTERNS.items()}
    for i, text in enumerate(texts):
        parts = [(m.start(), k, m.end(), secrets.PATTERNS[k][2]) for k, p in single.items() for m in p.finditer(text) if k in ("user", "assign", "endpoint", "access")]
        near = lambda p, role: any(q[3] == role and abs(q[0] - p[0]) <= 120 for q in parts)  # noqa: E731,B023
        want = sorted((p[0], p[1]) for p in parts if {"secret": near(p, "id"), "id": near(p, "secret"), "endpoint": near(p, "id") and near(p, "secret")}[p[3]])
        assert sorted((s["start"], s["kind"]) for s in found[i]) == want


def test_awkward_rows(awkward):
    found = scanned(secrets.scan(awkward))
    assert len(found) == awkward.count()
    assert all(spans == [] for i, spans in found if i in (3, 4, 5))
    assert secrets.scan(awkward.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
