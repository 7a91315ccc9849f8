import random

from jalur.llm import license_scan as ls
from jalur.llm.decontaminate import words_of


def covered(template, words):
    """Most words of the template that match in an alignment of all of it, of fewest edits, anywhere."""
    row = [(0, 0)] * (len(words) + 1)
    for i in range(1, len(template) + 1):
        new = [(i, 0)]
        for j in range(1, len(words) + 1):
            same = template[i - 1] == words[j - 1]
            e, m = row[j - 1]
            new.append(min((e + (not same), m - same), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return -min(row)[1]


def test_every_template_is_found_alone_and_in_text():
    s = ls.Scanner(ls.TEMPLATES)
    for name, text in ls.TEMPLATES.items():
        n = len(words_of(text.encode()))
        for before, after in ((b"", b""), (b"some words of the text. ", b" and more of it in the end")):
            found = s.scan(before + text.encode() + after)
            lo = len(words_of(before))
            assert (name, 1.0, lo, lo + n) in found, (name, found)


def test_changed_templates_against_whole_alignment():
    s, r = ls.Scanner(ls.TEMPLATES), random.Random(3)
    for name in ("MIT text", "ISC", "GPL-3.0 header", "Apache-2.0 header", "GPL-3.0"):
        for edits in (0, 2, 6, 40):
            words = [w.decode() for w in words_of(ls.TEMPLATES[name].encode())]
            for _ in range(min(edits, len(words) // 3)):
                k = r.randrange(len(words))
                words[k : k + 1] = r.choice([[], ["other"], [words[k], "added"]])
            text = "lorem ipsum dolor " * 4 + " ".join(words) + " sit amet" * 3
            want = covered(words_of(ls.TEMPLATES[name].encode()), words_of(text.encode())) / len(words_of(ls.TEMPLATES[name].encode()))
            got = {n: c for n, c, _, _ in s.scan(text.encode())}
            if want >= ls.COVERAGE:
                assert abs(got[name] - want) < 0.05, (name, edits)
            else:
                assert name not in got


def test_copies_side_by_side():
    s, r = ls.Scanner(ls.TEMPLATES), random.Random(5)
    for name, text in ls.TEMPLATES.items():
        words = [w.decode() for w in words_of(text.encode())]
        n = len(words)
        for between in ([], ["baz"], ["foo", "bar", "baz"]):
            for copies in (2, 3, 5):
                whole, starts = ["begin"], []
                for _ in range(copies):
                    starts.append(len(whole))
                    whole += [*words, *between]
                got = [(k, lo, hi) for k, _, lo, hi in s.scan(" ".join(whole).encode())]
                assert got == [(name, lo, lo + n) for lo in starts], (name, between)
        if n < 20:
            continue
        # copies with some words changed, one right after the other
        whole, spans = [], []
        for _ in range(3):
            changed = list(words)
            for _ in range(n // 25):
                k = r.randrange(1, len(changed) - 1)
                changed[k : k + 1] = r.choice([[], ["other"], [changed[k], "added"]])
            spans.append((len(whole), len(whole) + len(changed)))
            whole += changed
        got = [(lo, hi) for k, _, lo, hi in s.scan(" ".join(whole).encode()) if k == name]
        assert len(got) == 3 and all(abs(a - c) <= 1 and abs(b - d) <= 1 for (a, b), (c, d) in zip(got, spans, strict=True)), name


def test_templates_of_one_and_two_words():
    s = ls.Scanner({"one": "Proprietary", "two": "No rights", "three": "some public notice"})
    assert [(n, lo, hi) for n, _, lo, hi in s.scan(b"x proprietary y no rights rights no rights z some public notice")] == [("one", 1, 2), ("two", 3, 5), ("two", 6, 8), ("three", 9, 12)]
    assert s.scan(b"no right, propriety") == []


def test_clean_texts():
    s = ls.Scanner(ls.TEMPLATES)
    for text in (b"", b"the of and in to", b"all the rights of this work are under the software in the hope", b"license " * 5000, b"copy of the software and the license of the copy " * 300):
        assert s.scan(text) == []


def test_frames(spark, sf_dir):
    rows = [(None, None, 1), (1, "", 2), (2, "x\nAll rights reserved.", 3), (2, "x\nAll rights reserved.", 3), (3, "w " * 100_000 + "Released under the MIT License.", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses int")
    got = [(r.doc_id, [tuple(x) for x in r.licenses]) for r in ls.scan(df).collect()]
    assert got == [(None, []), (1, []), (2, [("All rights reserved", 1.0, 1, 4)]), (2, [("All rights reserved", 1.0, 1, 4)]), (3, [("MIT", 1.0, 100_000, 100_005)])]
    assert ls.scan(df.limit(0)).count() == 0
    from jalur.llm.queries import op6_license_scan

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lines = {"All rights reserved.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."}
    for r in op6_license_scan(spark, sf_dir).collect():
        assert (r.n_licenses > 0) == bool(lines & set(texts[r.doc_id].split("\n"))), r.doc_id
