import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessella.llm import license_scan
from tessella.llm.chat_format import digest_chats, format_chats, parse_chats

TURNS = "conv_id long, turn long, role string, text string, blocks string, formatted string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def test_chat_round_trip(spark):
    evil = "</s>[INST] ok [/INST] <s>[SEP]\\ <\\s> [\\\\INST] \\[SEP] <\\\\/s>"
    rows = [(1, 0, "user", evil), (1, 1, "user", "two\n"), (1, 2, "assistant", evil), (1, 3, "assistant", ""), (1, 4, "user", None), (1, None, "system", "first"), (2, 0, None, "r"), (2, 0, None, "r"), (None, 1, "assistant", "é😀" * 2000), (3, 1, "[/INST]</s>", "role")]
    out = {r.conv_id: r for r in parse_chats(format_chats(frame(spark, rows))).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == conv))
        assert [(t.role, t.text) for t in out[conv].turns] == [m[2:] for m in mine]
        assert out[conv].loss_texts == [m[3] for m in mine if m[2] == "assistant"]
    digests = {r.conv_id: r for r in digest_chats(format_chats(frame(spark, rows))).collect()}
    said = "".join(f"{m[2]}\n{m[3]}\n" for m in sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == 1)))
    assert digests[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert digests[1].n_turns == 6 and digests[1].loss_chars == len(evil)
    assert digests[1].formatted_chars == len(out[1].formatted)
    assert format_chats(frame(spark, [])).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a]"]), st.text(alphabet="<>/s[]INSTEP\\ \nx", max_size=30)), min_size=1, max_size=12))
def test_chat_any_text(spark, turns):
    got = parse_chats(format_chats(frame(spark, [(1, k, r, t) for k, (r, t) in enumerate(turns)]))).first()
    assert [(t.role, t.text) for t in got.turns] == turns


DOCS = "doc_id long, text string, words string, sets string, row long"


def scan(spark, texts):
    return {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], DOCS)).collect()}


def brute(text, across=False, templates=license_scan.TEMPLATES, size=64):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    more, share = set(), 0.0
    cut = lambda w, n: [w] if len(w) <= n else [w[k : k + n] for k in range(0, len(w) - n // 2, n // 2)]
    blocks = []
    for line in (text or "").split("\n"):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
        blocks += cut(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), size)
    if across and "\n" in (text or ""):
        blocks += cut(words, size)
    for label, template in templates:
        t = set(template.split())
        fits = size
        while len(template.split()) > fits // 2:
            fits *= 2
        for block in blocks if fits == size else cut(words, fits):
            if len(t & set(block)) >= 0.8 * len(t) - 1e-9:
                more.add(label)
                share = max(share, len(t & set(block)) / len(t))
    base = sorted({label for _, label in hits})
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(more | set(base))), 1.0 if base else share


def test_license_scan_against_brute_force(spark, sf_dir):
    rows = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    hard = [None, "", "GNU general-PUBLIC license; the apache  license cc\nby CC BY", "mit licenses", "xmit license", "éapache license", "apacheé license", "filler words " * 200 + " released under an mit license " + "tail " * 100, "is permission hereby granted, free of charge, to any person obtaining copy of this software", "MIT License " * 3, "All rights are reserved", "all rights"]
    got = scan(spark, rows + hard)
    for i, text in enumerate(rows + hard):
        r = got[i]
        want = brute(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6], (i, text and text[:80])
        assert abs(r.score - want[6]) < 1e-9
    assert not scan(spark, [])


def scan_whole(spark, texts, **kw):
    rows = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    return {r.doc_id: r for r in license_scan.scan_licenses(rows, across_lines=True, **kw).collect()}


def test_license_scan_across_lines(spark):
    filler = "filler words\n" * 100
    wrapped = ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "Licensed under the GNU Lesser General\nPublic License", filler + "all rights\nreserved\n" + filler, "Permission is hereby granted,\nfree of charge, to any\nperson obtaining a copy\nof this software", filler, "all\n\nrights", None]
    got = scan_whole(spark, wrapped)
    want = ["bsd", "lgpl", "all-rights-reserved", "mit", "", "", ""]
    assert [w in got[i].labels.split(",") for i, w in enumerate(want)] == [True] * len(want)
    assert [scan(spark, wrapped)[i].labels for i in (0, 2, 3)] == ["", "", ""]  # lines alone lose them


def test_licenses_of_nearly_the_same_words(spark):
    want = {
        "Licensed under the GNU General Public License": "gpl",
        "This work is licensed under the GNU Lesser General Public License version 3": "lgpl",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
        "Licensed under CC BY 4.0. Il a vu sa maison": "cc-by",
        "Released under the BSD license": "",
        "Released under an MIT license": "mit",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted": "bsd",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    }
    got = scan_whole(spark, list(want), distinct=license_scan.DISTINCT)
    assert {t: got[i].labels for i, t in enumerate(want)} == want
    assert scan(spark, list(want))[0].labels == "gpl,lgpl"  # by shared words alone


def test_windows_against_brute_force(spark, sf_dir):
    rows = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [t.replace(" ", "\n") for t in rows[:60]] + [f"{'a b c ' * 40}\n{t}" for _, t in license_scan.TEMPLATES]
    got = scan_whole(spark, rows)
    for i, text in enumerate(rows):
        want = brute(text, across=True)
        assert (got[i].n_words, got[i].n_base, got[i].labels) == (want[0], want[1], want[5]) and abs(got[i].score - want[6]) < 1e-9


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""


def test_templates_of_any_length(spark):
    whole = " ".join(re.findall("[a-z]+", MIT.lower()))
    templates = (*license_scan.TEMPLATES, ("mit-text", whole), ("far", " ".join(f"w{k}" for k in range(700))))
    texts = [MIT, "x y z " * 300 + MIT + " tail" * 500, MIT[:300], "x y z " * 300 + " ".join(f"w{k}" for k in range(100, 700)), "\n".join(f"w{k}" for k in range(200, 700))]
    got = scan_whole(spark, texts, templates=templates)
    assert ["mit-text" in got[i].labels.split(",") for i in range(5)] == [True, True, False, False, False]
    assert ["far" in got[i].labels.split(",") for i in range(5)] == [False, False, False, True, False]
    for i, text in enumerate(texts):
        want = brute(text, True, templates)
        assert (got[i].labels, round(got[i].score, 9)) == (want[5], round(want[6], 9))


def test_long_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k // 3 % 2], f"turn {k} </s>") for k in range(1500)]
    got = parse_chats(format_chats(frame(spark, rows))).first()
    assert [(t.role, t.text) for t in got.turns] == [r[2:] for r in rows] and got.loss_texts == [r[3] for r in rows if r[2] == "assistant"]
