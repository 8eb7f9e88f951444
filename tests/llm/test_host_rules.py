import re
from collections import Counter, defaultdict

from fixlog.llm import host_rules as H


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def rates(rows):
    """Shrunk rates by host, by hand."""
    hosts = defaultdict(list)
    for _, text, host in rows:
        hosts[host or ""].append(measures(text))
    tests = {"short": lambda m: m[0] < 20, "repeats": lambda m: m[4] * 100 > m[0] * 30, "symbols": lambda m: m[2] * 10 > m[1] * 3, "lines": lambda m: m[3] * 100 > m[0] * 5}
    out = defaultdict(float)
    for test in tests.values():
        f = {h: sum(map(test, ms)) for h, ms in hosts.items()}
        n = {h: len(ms) for h, ms in hosts.items()}
        total = sum(n.values())
        m = sum(f.values()) / total
        v = sum(f[h] ** 2 / n[h] for h in n) / total - m * m
        weight = min(max(m * (1 - m) / v - 1 if v > 1e-12 else 1e4, 1.0), 1e4)
        for h in n:
            out[h] = max(out[h], (f[h] + m * weight) / (n[h] + weight))
    return out


def check(df, rows, limit=H.LIMIT):
    want, rate = Counter(), rates(rows)
    for d, text, host in rows:
        m = measures(text)
        base = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want[(d, *m, base, not base and rate[host or ""] <= limit, round(rate[host or ""], 6))] += 1
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.host_rate, 6)) for r in H.judge(df, limit=limit).collect())
    assert got == want


def test_odd(odd, odd_rows):
    check(odd, [(r[0], r[1], r[3]) for r in odd_rows])
    check(odd, [(r[0], r[1], r[3]) for r in odd_rows], 0.3)


def test_sample(sample):
    check(sample, [(r.doc_id, r.text, r.source) for r in sample.collect()])


def test_repeats_and_lines(spark):
    texts = [" ".join(f"a{i % 11}" for i in range(60)), "x y\nx y\r\nx y\n \n \nx y", "a b c d e f g h " * 4, "\n".join(["line of words here"] * 30)]
    rows = [(i, t, "bad" if i < 3 else "good") for i, t in enumerate(texts)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows)


def test_bad_host_is_turned_away(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)) if i % 10 == 0 or i >= 300 else "short", f"h{i // 100}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(df, rows)
    kept = {r.doc_id for r in H.judge(df).collect() if r.kept}
    assert kept == set(range(300, 900))


def test_empty(empty):
    assert H.judge(empty).collect() == []
