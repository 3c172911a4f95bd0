import hashlib
import random
import re
import time

from siftlab.llm import pii
from tests.llm.samples import awkward_documents, docs_frame, document

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    seen = 0
    for _ in range(30_000):
        text = "".join(rng.choice(rng.choice(["a@.-", "0123456789.", "0 1-2+()", "@a.b", "xé ＠"])) for _ in range(rng.randint(0, 40)))
        want = brute(text)
        assert pii.base_spans(text) == want, text
        seen += len(want)
    assert seen > 1000


def hidden(text):
    return [(k, text[a:b]) for k, a, b in pii.hidden_spans(text, pii.base_spans(text))]


def test_disguises_map_back():
    assert hidden("mail john dot doe at example dot com now") == [("email", "john dot doe at example dot com")]
    assert hidden("j [at] ex [dot] com!") == [("email", "j [at] ex [dot] com")]
    assert hidden("x＠ｅx.com") == [("email", "x＠ｅx.com")]
    assert hidden("see jоhn@exаmple.com, ok") == [("email", "jоhn@exаmple.com")]
    assert hidden("call plus four nine one five one two three four five six") == [("phone", "plus four nine one five one two three four five six")]
    assert hidden("one nine two dot one six eight dot zero dot one") == [("ip", "one nine two dot one six eight dot zero dot one")]
    assert hidden("we met at noon dot dash, one of two at 3") == []
    assert hidden("look at example dot com") == [] and hidden("we are at example dot org") == []
    assert hidden("plain a@b.co and 1.2.3.4 (at home)") == []


def by_characters(text, base):
    """The way back kept as one source range per character, every span held against all others."""
    seen, origin = text, [(i, i + 1) for i in range(len(text))]
    for step in (pii._char_edits, pii._bracket_edits, pii._digit_edits, pii._spoken_edits, pii._dot_edits):
        out, ranges, at = "", [], 0
        for a, b, new in sorted(step(seen)):
            if a >= at:
                out += seen[at:a] + new
                ranges += origin[at:a] + [(origin[a][0], origin[b - 1][1])] * len(new)
                at = b
        seen, origin = out + seen[at:], ranges + origin[at:]
    found = []
    for kind, a, b in pii.base_spans(seen) if seen != text else []:
        a, b = origin[a][0], origin[b - 1][1]
        if all(b <= s or a >= e for k, s, e in base + found if k == kind):
            found.append((kind, a, b))
    return found


def test_the_way_back_equals_one_range_per_character():
    rng = random.Random(5)
    parts = ["john", " at ", " dot ", "com", "[at]", " (dot) ", "@", ".", "exаmple", "＠", "​", "one ", "two ", "three ", "4 ", "+", "plus ", "5", "é", " ", "a@b.co", "1.2.3.4"]
    seen = 0
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        base = pii.base_spans(text)
        got = pii.hidden_spans(text, base)
        assert got == by_characters(text, base), text
        seen += len(got)
    assert seen > 500


def test_a_very_long_text_takes_seconds():
    text = "mail john dot doe at example dot com now; " * 250_000  # over 10 MB
    begun = time.monotonic()
    assert len(pii.hidden_spans(text, pii.base_spans(text))) == 250_000
    assert time.monotonic() - begun < 60


def test_rows(spark):
    rows = awkward_documents() + [document(50, "x (at) y.org, a@b.co"), document(51, "b" * 100_000 + " q@r.de " + "7" * 100_000)]
    got = {}
    for r in pii.find_personal_data(docs_frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, *_ in rows:
        base = brute(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        for r in got[doc_id] if doc_id is not None else []:
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
            assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert got[50][0]["spans"] == "email:0:12,email:14:20" and got[50][0]["n_hidden"] == 1
    assert got[51][0]["spans"] == "email:100001:100007" and len(got[4]) == 2 and got[2][0]["spans"] == ""
    assert pii.find_personal_data(docs_frame(spark, [])).count() == 0
