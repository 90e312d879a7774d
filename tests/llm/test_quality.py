from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.llm import quality


def brute_repeats(words, n=5):
    g = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    hit = {p for i in range(len(words) - n + 1) if g[tuple(words[i : i + n])] > 1 for p in range(i, i + n)}
    return len(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=40))
def test_repeat_words(words):
    assert quality.repeat_words(words) == brute_repeats(words)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#*é \x1c|"), max_size=60))
def test_measures(text):
    words = text.encode().split()
    lines = text.split("\n")
    dup = sum(1 for i, l in enumerate(lines) if l.encode().split() and l in lines[:i])
    want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, brute_repeats(words))
    assert quality.measure(text.encode()) == want


def brute(rows, max_docs):
    seen = defaultdict(set)
    norm = lambda l: b" ".join(l.encode().lower().split())
    for d, t, s in rows:
        for l in (t or "").split("\n"):
            if l.encode().split():
                seen[s, norm(l)].add((d is None, d, t))
    out = Counter()
    for d, t, s in rows:
        n, chars, sym, dup, rep = quality.measure((t or "").encode())
        gone = 0
        for l in (t or "").split("\n"):
            held = seen.get((s, norm(l)), set())
            if len(held) > max_docs and min(held, key=lambda x: (x[0], x[1] or 0)) != (d is None, d, t):
                gone += len(l.encode().split())
        failed = n < 10 or 100 * rep > 20 * n
        out[d, n, failed, gone, not failed and n - gone >= 5 and n - gone >= 0.2 * n] += 1
    return out


def corpus(odd_rows):
    words = " ".join(f"word{i}" for i in range(14))
    rows = list(odd_rows)
    for i in range(12):
        rows.append((100 + i, f"Cookie  notice\n{words} number{i}\nunique line {i}", "a" if i % 3 else None))
        rows.append((200 + i, "\n".join(f"menu entry {k} of this site" for k in range(6)) + f"\nonly {i} words of its own are left here now then", "m"))
    copied = "\n".join(" ".join(f"w{i}x{k}" for k in range(40)) for i in range(3))  # long lines in many copies
    rows += [(300 + i, copied, "k") for i in range(8)]
    return [*rows, rows[-1], (None, copied, "k")]


def test_verdicts(docs_of, odd_rows):
    rows = corpus(odd_rows)
    got = quality.judge(docs_of(rows), max_docs=3).collect()
    assert Counter((r.doc_id, r.n_words, r.base_failed, r.removed_words, r.kept) for r in got) == brute(rows, 3)
    assert {r.doc_id for r in got if r.kept and (r.doc_id or 0) >= 300} == {300}  # of the copies the first stays
    assert quality.judge(docs_of(rows).limit(0)).count() == 0


def test_cleaning(docs_of, odd_rows):
    rows = corpus(odd_rows)
    kept = {d: k for d, _, _, _, k in brute(rows, 3)}
    out = quality.clean(docs_of(rows), max_docs=3).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _, _ in rows if kept[d])
    text = {r.doc_id: r.text for r in out}
    assert "Cookie" in text[101] and text[102].startswith("word0") and text[102].endswith("unique line 2")
    assert len(text[300].split("\n")) == 3 and 301 not in text
    clash = docs_of(rows, extra=("__key", "row", "key", "id", "new", "removed_lines", "h", "first"))
    assert {r["__key"] for r in quality.clean(clash, max_docs=3).collect()} == {"clash"}
    assert quality.clean(docs_of(rows).limit(0)).count() == 0
    assert "Cookie" in text[100] and text[103].startswith("word0")  # of the null host, 100 being its first
    assert set(out[0].asDict()) == set(docs_of(rows).columns)
