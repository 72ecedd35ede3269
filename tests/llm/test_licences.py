import random

import duckdb
import pytest

from corvane.llm import licences as L
from corvane.llm import queries


def brute(text, templates=L.TEMPLATES, threshold=0.8):
    """(template, start) of every window that meets its template, by looking at all of them."""
    words, out = L.words_of(text), set()
    for k, t in enumerate(templates):
        t = L.Template(*t)
        s = L.shape(t, threshold)
        own = set(s.words)
        for i in range(max(0, len(words) - s.width) + 1):
            b = set(words[i : i + s.width])
            if len(own & b) >= s.need and set(t.must) <= b and not (set(t.without) - own) & b:
                out.add((k, i))
    return out


def stretches(text, met, templates=L.TEMPLATES, threshold=0.8):
    words, out = L.words_of(text), []
    for k, t in enumerate(templates):
        s = L.shape(t, threshold)
        starts = sorted(i for j, i in met if j == k)
        while starts:
            n = next((n for n in range(1, len(starts)) if starts[n] != starts[n - 1] + 1), len(starts))
            best = max(len(set(s.words) & set(words[i : i + s.width])) for i in starts[:n])
            out.append((k, starts[0], min(starts[n - 1] + s.width, len(words)) - 1, best / len(s.words)))
            starts = starts[n:]
    return out


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation"""
APACHE = "Licensed under the\nApache License, Version\n2.0 (the License)"


def texts():
    return [
        "Licensed under the Apache License, Version 2.0.\nother words", "released the MIT license under seal", "no licence here", None, "", "all rights reserved. ALL RIGHTS\nRESERVED cc by",
        " ".join(["word"] * 100) + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation " + " ".join(["tail"] * 100),
        "general public license version 3 work is licensed under gnu", "é" * 50_000, MIT, BSD, GPL, LGPL, APACHE, "Released under the Apache License", "Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        MIT + "\n" + " and so on" * 30 + "\n" + GPL, "Licensed under CC BY 4.0 " * 3,
    ]


def test_exactly_the_windows_of_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    for i, t in enumerate(texts()):
        want = stretches(t, brute(t))
        assert sorted((m.first_word, m.last_word, m.containment) for m in got[i].matches) == sorted(w[1:] for w in want)
    assert got[0].labels == "apache" and got[1].labels == "mit" and got[5].base_labels == "cc-by,reserved" and got[5].n_base == 3 and (got[5].first_word, got[5].last_word) == (0, 6)
    assert got[3].n_words == 0 and got[3].first_word is None and got[3].labels == "" and got[6].labels == "mit" and got[8].n_words == 1
    assert [got[k].labels for k in range(9, 18)] == ["mit", "bsd", "gpl", "lgpl", "apache", "", "cc-by-nc", "cc-by-sa", "gpl,mit"] and got[15].base_labels == "cc-by" or got[15].labels == "cc-by,cc-by-nc"


def test_random_texts_under_any_word_order():
    r = random.Random(4)
    pool = [w for t in L.TEMPLATES for w in L.words_of(t.text)] + ["nc", "sa", "lesser"]
    long = L.Template("long", " ".join(f"w{k}" for k in range(160)))
    every = [*L.TEMPLATES, long]
    a, b = L.Index(every, {}, 0.8), L.Index(every, {w: len(w) * 7 % 5 for w in pool}, 0.8)
    for _ in range(150):
        words = []
        while len(words) < 120:
            t = L.words_of(r.choice(L.TEMPLATES).text)
            words += [w if r.random() < 0.93 else r.choice(pool) for w in t] if r.random() < 0.5 else r.choices(pool, k=5)
        want = stretches(" ".join(words), brute(" ".join(words), every), every)
        assert sorted(a.matches(words)) == sorted(want) == sorted(b.matches(words))
    cut = L.words_of(long.text)
    assert [m[0] for m in a.matches(["x"] * 90 + cut[:70] + ["y"] * 3 + cut[80:] + ["z"])] == [len(every) - 1]


def test_templates_that_can_not_be_served():
    for bad in (L.Template("none", "..."), L.Template("other", "some words", ("elsewhere",))):
        with pytest.raises(ValueError):
            L.shape(bad, 0.8)
    with pytest.raises(ValueError):
        L.Index([L.Template("a", "b")] * (L.MAX_TEMPLATES + 1), {}, 0.8)


def test_the_statement_says_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(2, "Released under the MIT License")] * 2, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op2_license_join"])
    names = [c[0] for c in want.description]
    got = queries.op2_license_join(spark, str(tmp_path))
    key = lambda row: str(row)
    assert sorted(map(key, want.fetchall())) == sorted(map(key, (tuple(r) for r in got.select(*names).collect())))


def test_awkward_tables(docs, clashing, nothing):
    assert L.scan(docs).count() == docs.count() == L.scan(clashing).count()
    assert L.scan(nothing).collect() == []
