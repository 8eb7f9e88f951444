import re
import textwrap

import duckdb
import pytest

from fixlog.llm import license_rules as L


def by_hand(text):
    ids = [L.known()[s] for line in re.sub(L.ENDS, "\\1\n", (text or "").lower()).split("\n") if (s := L.normalise(line)) in L.known()]
    chain = ">" + ">".join(ids) + ">"
    hits = list(dict.fromkeys(name for name, seq in L.RULES if ids and ">" + ">".join(seq) + ">" in chain))
    return len(ids), ">".join(ids), ",".join(hits), hits[0] if hits else "unknown" if ids else "none"


def test_tables():
    for forms in L.SENTENCES.values():
        for s in forms:
            assert any(a in s.lower() for a in L.ANCHORS), s
    names = set(L.SENTENCES)
    assert all(set(seq) <= names for _, seq in L.RULES)


def test_rules(spark):
    mit = " ".join(L.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "mit-warranty"))
    texts = [mit, mit.upper(), "Some prose. Licensed under CC BY-NC 4.0. More.", "licensed under the  apache license -- version 2.0", "All rights reserved.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "you may license this", "", None, "\n".join([L.SENTENCES["apache2-grant"][0], L.SENTENCES["apache2-comply"][0]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_sentences, r.sentence_ids, r.licences, r.verdict) for r in L.recognise(df).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}
    assert [got[i][3] for i in (0, 2, 3, 4, 5, 6, 7)] == ["MIT", "CC-BY-NC-4.0", "Apache-2.0", "Proprietary", "unknown", "none", "none"]


def test_odd_and_oracle(odd, odd_rows, empty, sample):
    documents = odd.toPandas()  # noqa: F841  read by DuckDB
    want = duckdb.sql(L.oracle()).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    got = [tuple(r) for r in L.recognise(odd).collect()]
    assert len(got) == len(odd_rows) and sorted(map(key, got)) == sorted((("None" if r[0] is None or r[0] != r[0] else str(int(r[0]))), *map(str, r[1:])) for r in want)
    assert L.recognise(empty).collect() == []
    assert all(tuple(r)[1:] == by_hand(t) for r, t in zip(L.recognise(sample).orderBy("doc_id").collect(), [r.text for r in sample.orderBy("doc_id").collect()]))


def ids_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.sentence_ids, r.verdict) for r in L.recognise(df).orderBy("doc_id").collect()]


def test_every_form_is_found(spark):
    """Each known form yields its own identifier, alone and between other sentences."""
    forms = [(name, s) for name, all_forms in L.SENTENCES.items() for s in all_forms]
    assert [i for i, _ in ids_of(spark, [s for _, s in forms])] == [name for name, _ in forms]
    assert [i for i, _ in ids_of(spark, [f"Some words. {s}  More words." for _, s in forms if s[-1] in ".;:"])] == [name for name, s in forms if s[-1] in ".;:"]


def test_gpl_notice(spark):
    grant, warranty = (L.SENTENCES[k][0] for k in ("gpl-grant", "gpl-warranty"))
    texts = [grant, f"{grant} {warranty} without even the implied warranty", grant.split(": ")[0] + ": other words. " + grant.split(": ")[1]]
    got = ids_of(spark, texts)
    assert got[:2] == [("gpl-grant", "GPL-3.0-or-later"), ("gpl-grant>gpl-warranty", "GPL-3.0-or-later")]
    assert got[2] == ("", "none")


NOTICES = {
    "MIT": ("mit-grant", "mit-notice", "mit-warranty"),
    "BSD": ("bsd-grant", "bsd-warranty"),
    "GPL-3.0-or-later": ("gpl-grant", "gpl-warranty"),
    "Apache-2.0": ("apache2-grant", "apache2-comply", "apache2-copy", "as-is"),
}


def wrapped(sentence, width, mark="", tail="", end="\n"):
    return end.join(f"{mark}{line}{tail}" for line in textwrap.wrap(sentence, width, break_long_words=False, break_on_hyphens=False))


@pytest.mark.parametrize(("mark", "tail", "end"), [("", "", "\n"), ("", "", "\r\n"), (" * ", "", "\n"), ("# ", " ", "\n"), ("// ", "", "\r\n"), ("/* ", " */", "\n"), ("; | ", " |", "\n")])
def test_wrapped(spark, mark, tail, end):
    """Notices and single sentences in lines of any width, with comment marks and blank lines between paragraphs."""
    for width in (20, 40, 72):
        blank = f"{end}{mark}{tail}{end}"
        texts = [blank.join(wrapped(L.SENTENCES[k][-1], width, mark, tail, end) for k in keys) for keys in NOTICES.values()]
        texts += [f"Words before.{end}" + wrapped(" ".join(L.SENTENCES[k][0] for k in keys if k != "apache2-copy"), width, mark, tail, end) + f"{end}{mark}Words after." for keys in NOTICES.values()]
        got = ids_of(spark, texts)
        assert got[:4] == [(">".join(keys), name) for name, keys in NOTICES.items()]
        assert got[4:] == [(">".join(k for k in keys if k != "apache2-copy"), name) for name, keys in NOTICES.items()]
    forms = [(name, s) for name, all_forms in L.SENTENCES.items() for s in all_forms]
    assert [i for i, _ in ids_of(spark, [wrapped(s, 12, mark, tail, end) for _, s in forms])] == [name for name, _ in forms]


def test_no_sentence_across_paragraphs(spark):
    texts = ["All rights\n\nreserved.", "All rights\n * \nreserved.", "All rights\r\n\r\n\r\nreserved.", "All rights other reserved.", "All rights\nreserved words.", "Not all rights\nreserved.", "All rights\nreserved."]
    assert [v for _, v in ids_of(spark, texts)] == ["none"] * 6 + ["Proprietary"]
