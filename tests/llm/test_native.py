"""License scans and quality rules against brute force, and that their plans hold no Python."""

import collections
import math
import random
import re

import brute
from ward_analytics.llm import licenses, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROWS = [
    (1, "Intro.\nThis work is licensed under the GNU General\nPublic License, version 3."), (2, "Released under the MIT License."), (3, None), (4, ""),
    (5, "CC-BY and cc by; Apache   License apache license"), (6, "permission is hereby granted to any person obtaining a copy of this software free of charge and files"),
    (6, "mit license"), (None, "MIT license"), (None, "MIT license"), (7, "ÀÉ é license 12 ŋ"), (8, "mit\x00license x license"), (9, "word " * 3000 + "apache license"),
]


def expected(text):
    low = brute.lower(text)
    words, starts, base, more = WORD.findall(low), [], set(), set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        starts += here
        base |= {label} if here else set()
    for block in re.split(r"\n[\t\x0b\x0c\r ]*\n", low):
        found = WORD.findall(block)
        beside = set(zip(found, found[1:]))
        for label, notice in licenses.TEMPLATES.items():
            t = notice.split()
            pairs = set(zip(t, t[1:]))
            own = set(t) - {w for k, x in licenses.TEMPLATES.items() if k != label for w in x.split()}
            if 2 * len(own & set(found)) >= len(own) and len(set(found) & set(t)) >= licenses.least_words(len(set(t))) and 2 * len(beside & pairs) >= len(pairs):
                more.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))


def test_licenses(frame):
    df = frame(ROWS)
    found = licenses.scan(df)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in found.collect()), key=str)
    assert got == sorted(((d, *expected(x)) for d, x in ROWS), key=str)
    assert all(0 <= r.score <= 1 and (r.score == 1 or not r.base_labels) for r in found.collect())
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert licenses.scan(df.where("doc_id < 0")).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction"""
BSD = """Redistribution and use in source and binary forms, with or
    without modification, are permitted provided that the
    following conditions are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License."""
APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at"""


def test_wrapped_notices_are_found_and_common_words_are_not(frame):
    common = " ".join(sorted({w for t in licenses.TEMPLATES.values() for w in t.split()}))
    texts = [MIT, BSD, GPL, APACHE, f"code\n\n{MIT}\n \t\nmore code", common, MIT.replace("granted,", "granted\n\n"), "\n\n\n\n", f"x\r\n\r\n{BSD}\r\n\r\ny"]
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in licenses.scan(frame(rows)).collect()}
    assert [found[d].labels for d, _ in rows] == [expected(x)[-1] for _, x in rows]
    assert [found[d].labels.split(",") for d in (0, 1, 2, 3)] == [["mit-notice"], ["bsd"], ["gpl", "gpl-3.0", "gpl-notice"], ["apache", "apache-2.0", "apache-notice"]]
    assert found[0].score == found[4].score == 1.0 and found[5].labels == "" and found[5].score == 0.0 and found[8].labels == "bsd"


def test_prefixes_miss_no_block():
    for n in range(1, 40):
        assert licenses.prefix_size(n) + licenses.least_words(n) == n + 1


def quality_rows():
    line = "one two three four five six seven eight nine ten"
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good + f" x{i}", "en", "a") for i in range(80)] + [(100 + i, "# $ % " * 40 + f"y{i}", "de", None) for i in range(60)]
    rows += [(200, " ".join(f"{w} ##" for w in good.split()), "en", "a"), (201, f"{line}\n{line}\n{line} {good}", None, "a"), (202, None, "en", "a")]
    return rows + [(203, "", "en", None), (204, "a\tb\x0bc\x0cd\re f\n\n \nf\nf", "fr", "b"), (205, "ab " * 30, "en", "a"), (None, good, "en", "a"), (206, "é# " * 25, "en", "a"), (0, good, "en", "a")]


def test_quality(workers):
    df = workers.createDataFrame([(*r, 1, "x") for r in quality_rows()], "doc_id long, text string, lang string, source string, n_words int, kept string").repartition(3)
    found = quality.judge(df)
    got, want = [], []
    for r in found.collect():
        got.append((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    for d, text, _, _ in quality_rows():
        words, lines = brute.words(text), [x for x in (text or "").split("\n") if brute.words(x)]
        times = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        want.append((d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)))
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert all(kept[i] for i in range(80)) and not kept[200] and not kept[202] and not kept[205]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert quality.judge(df.where("doc_id < 0")).collect() == []


def measured(text):
    words, lines = brute.words(text), [x for x in (text or "").split("\n") if brute.words(x)]
    times = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = max(len(words), 1)
    counts = {"n_symbols": (len(re.findall(r"[#*$%&|<>]", text or "")), n, 1), "n_dup_lines": (len(lines) - len(set(lines)), max(len(lines), 1), 1), "n_repeat_words": (len(covered), n, 8)}
    return len(words), counts, sum(map(len, words)) / n


def far_by_brute_force(rows):
    """The measures of each row that are far from its group, from exact quartiles."""
    every = [(lang, source, *measured(text)) for _, text, lang, source in rows]

    def quartiles(some):
        ordered = {m: sorted(r[3][m][0] / r[3][m][1] for r in some) for m in quality.COUNTED}
        ordered |= {"n_words": sorted(r[2] for r in some), "chars_a_word": sorted(r[4] for r in some)}
        return {m: [v[math.ceil(q * len(v)) - 1] for q in (0.25, 0.5, 0.75)] for m, v in ordered.items()}, len(some)

    def mix(own, wider):
        (mine, n), share = own, own[1] / (own[1] + quality.PRIOR)
        return {m: [share * a + (1 - share) * b for a, b in zip(mine[m], wider[m], strict=True)] for m in mine}

    whole = quartiles(every)[0]
    out = []
    for lang, source, n, counts, mean in every:
        language = mix(quartiles([r for r in every if r[0] == lang]), whole)
        q = mix(quartiles([r for r in every if r[:2] == (lang, source)]), language)
        far = []
        for m, (count, size, one) in counts.items():
            _, median, high = q[m]
            if count > size * (median + 8 * (high - median) / 0.6745) + 8 * one * math.sqrt(size * median / one + 1):
                far.append(m)
        low, median, high = q["chars_a_word"]
        spread = (high - median if mean > median else median - low) / 0.6745
        if abs(mean - median) > 8 * (spread * math.sqrt(max(q["n_words"][1] / max(n, 1), 1)) + 1 / math.sqrt(max(n, 1))):
            far.append("chars_a_word")
        out.append(",".join(far))
    return out


def adaptive_rows():
    """Groups of plain texts, and in each rows that are far in one measure alone."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(rng.randint(3, 8)))
    plain = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for lang, source, n in (("a", "x", 90), ("a", "y", 4), ("b", "x", 60), (None, "x", 30), ("b", None, 1)):
        for _ in range(n):
            rows.append("\n".join(plain(20) for _ in range(10)) if lang == "a" else plain(rng.randint(120, 300)))
            rows[-1] = (rows[-1], lang, source)
    stutter = plain(12)
    odd = {
        "n_symbols": plain(200) + " $$$ ### *** %%%", "n_dup_lines": "\n".join([plain(40), *["ab cd"] * 12, plain(120)]),
        "n_repeat_words": " ".join([plain(200), *[f"{stutter} {word()}" for _ in range(6)], plain(200)]),
        "chars_a_word": " ".join(["abcdefghijklmnop"] * 0 + [f"x{i}" * 9 for i in range(200)]), "low": " ".join(chr(97 + i % 26) for i in range(26)) + " " + " ".join(f"{i}" for i in range(10, 200)),
    }
    rows += [(text, lang, source) for text in odd.values() for lang, source in (("a", "x"), ("b", "x"), ("a", "y"))]
    return [(i, *r) for i, r in enumerate(rows)]


def test_each_measure_alone_drops_what_base_rules_keep(workers):
    rows = adaptive_rows()
    df = workers.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    found = {r.doc_id: r for r in quality.judge(df).collect()}
    want = far_by_brute_force(rows)
    assert [found[i].far for i in range(len(rows))] == want
    alone = {found[i].far for i in range(len(rows)) if not found[i].base_failed and not found[i].kept}
    assert {"n_symbols", "n_dup_lines", "n_repeat_words", "chars_a_word"} <= alone
    assert all(found[i].kept for i in range(len(rows) - 15)) and not any(found[i].kept for i in range(len(rows) - 15, len(rows) - 1, 3))
