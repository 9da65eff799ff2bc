"""Sharding, fingerprints, toxicity, leaks and licences on odd rows, planted cases and brute force."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import decontam, edit_embedding, kd_shards, licenses, toxicity
from tastegrid.llm.components import components
from test_dedup import ordered

SF = "/root/testdata/sf0.01"


# --- k-d tree shards ---------------------------------------------------------------------


def test_op6_laws(spark, odd_docs, odd_rows, no_docs):
    got = kd_shards.kd_shards(odd_docs, 24).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert all(r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None for r in got)
    assert kd_shards.kd_shards(no_docs, 24).collect() == []
    docs = spark.read.parquet(SF + "/documents.parquet")
    rows = kd_shards.kd_shards(docs, 24).collect()
    sizes = np.bincount([r.shard for r in rows], [r["size"] for r in rows], 24)
    # Each split misses its quantile by at most half a row, so shards differ by a few rows at most.
    assert sizes.max() - sizes.min() <= 2 * max(r["size"] for r in rows)
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_op6_one_value_holds_all_rows(spark):
    docs = spark.createDataFrame([(i, "same text", "en", "one") for i in range(2_400)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(0)).withColumn("doc_id", F.expr("cast(rand(3) * 1e9 as long)"))
    counts = [r["count"] for r in kd_shards.kd_shards(kd_shards.stage(docs), 24).groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 4


def test_write_shards(spark, tmp_path):
    docs = spark.read.parquet(SF + "/documents.parquet")
    kd_shards.write_shards(docs, str(tmp_path / "out"), target_bytes=400_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    sizes = [r.s for r in back.groupBy("shard").agg(F.sum(F.octet_length("text") + 8).alias("s")).collect()]
    assert max(sizes) < 500_000


# --- edit embedding ----------------------------------------------------------------------


def test_op10_odd_rows(odd_docs, odd_rows, no_docs):
    rows = [(i, t) for i, t in ordered(odd_rows)]
    want = Counter()
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    got = edit_embedding.edited_likeness(odd_docs).collect()
    assert Counter(tuple(r)[:3] for r in got) == want
    by_text = {}
    for i, t in odd_rows:
        if i is not None and i < 20:
            by_text.setdefault(t or "", set()).update(r.fingerprint for r in got if r.doc_id == i)
    assert all(len(v) == 1 for v in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert edit_embedding.edited_likeness(no_docs).collect() == []


def test_op10_ids_beyond_doubles(spark):
    """Ids around 2 ** 62, closer than doubles are, and the least and largest: every row comes out, with its own next one."""
    rng = np.random.default_rng(12)
    ids = sorted({int(x) for x in (1 << 62) + rng.integers(0, 100_000, 800)} | {-(1 << 63) + 1, (1 << 63) - 1, 5})
    text = {i: f"text of {k} " * 3 for k, i in enumerate(ids)}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(5)
    got = edit_embedding.edited_likeness(docs).collect()
    want = Counter()
    for k, i in enumerate(ids):
        t, nxt = text[i], text[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        want[(i, hashlib.sha256((t[:len(t) - q] + nxt[:q]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_op10_edits_are_nearer_than_neighbours(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    rows = edit_embedding.edited_likeness(docs).filter("n_chars > 200").collect()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.99
    assert 0.7 < np.mean([r.near_edited for r in rows]) < 0.9


def test_walk_is_the_same_in_any_company():
    texts = ["abc" * 400, "x", "", "the quick brown fox " * 50]
    together = edit_embedding.Walk().fingerprints(texts)
    alone = [edit_embedding.Walk().fingerprints([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone))
    one_edit = edit_embedding.Walk().fingerprints([texts[3], texts[3][:200] + "!" + texts[3][200:]])
    assert edit_embedding.likeness(one_edit[:1], one_edit[1:])[0] > 0.6


def plain_fingerprint(walk, text):
    """The walk one character at a time; each slot keeps the symbol of its step of least priority."""
    out, least, pos, t = [0] * edit_embedding.SLOTS, [2.0] * edit_embedding.SLOTS, 0, 0
    while pos < len(text):
        if t % (1 << 16) == 0:
            rng = np.random.default_rng((walk.seed, t >> 16))
            own, priority = rng.integers(0, edit_embedding.SLOTS, 1 << 16).tolist(), rng.random(1 << 16).tolist()
        c = ((ord(text[pos]) * 2654435761 % 2**32) >> 16) % 255 + 1
        s, p = own[t % (1 << 16)], priority[t % (1 << 16)]
        if p < least[s]:
            out[s], least[s] = int(walk.symbol[c]), p
        pos += int(walk.moves[t % edit_embedding.PERIOD][c])
        t += 1
    return out


def test_walk_equals_one_character_at_a_time():
    """Short texts, and one whose walk goes on over several blocks of steps, before or after shorter ones."""
    rng = np.random.default_rng(6)
    texts = ["", "a", "\u00e9\U0001F600 z", *("".join(rng.choice(list("abcdef \u4e2d"), n)) for n in (30, 700, 90_000))]
    walk = edit_embedding.Walk()
    for order in (texts, texts[::-1]):
        for text in order:
            assert walk.fingerprints([text])[0].tolist() == plain_fingerprint(walk, text)
    assert walk.fingerprints(texts).tolist() == [plain_fingerprint(walk, t) for t in texts]


def test_similar_odd_rows(odd_docs, odd_rows, no_docs):
    """One row per row; rows without text are one group, named by the least doc_id."""
    got = edit_embedding.similar(odd_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows)
    assert {r.group_id for r in got if r.doc_id in (6, 7)} == {6}
    assert edit_embedding.similar(no_docs).collect() == []


def test_similar_groups(odd_docs):
    groups = {r.doc_id: r.group_id for r in edit_embedding.similar(odd_docs, threshold=0.5).collect() if r.doc_id is not None and r.doc_id <= 20}
    assert groups[3] == groups[4] == groups[5] == groups[20] == 3
    assert groups[1] == 1 and groups[12] == 12


def planted_fingerprints(n, pairs):
    """Random fingerprints with skewed symbols, each of the first ``pairs`` with a copy in which up to a fifth of the slots changed."""
    rng = np.random.default_rng(11)
    share = 1 / np.arange(1, 16)
    fp = (rng.choice(15, (n, edit_embedding.SLOTS), p=share / share.sum()) + 1).astype(np.uint8)
    near = fp[:pairs].copy()
    for row in near:
        at = rng.choice(edit_embedding.SLOTS, rng.integers(1, 26), replace=False)
        row[at] = row[at] % 15 + 1
    return np.concatenate([fp, near])


@pytest.mark.parametrize("width, bands, block", [(None, None, 4096), (2, 32, 4096), (2, 32, 16)])
def test_near_links_find_planted_pairs_at_every_load(spark, width, bands, block):
    """Buckets of one or two members, of about 70, and of 70 in blocks of 16: found pairs against all pairs."""
    fp = planted_fingerprints(1_500, 500)
    names = edit_embedding.written(fp)
    marks = spark.createDataFrame([(x,) for x in names], "fingerprint string")
    links = edit_embedding.near_links(marks, 0.8, bands, width, block=block)
    root = {r.node: r.root for r in components(links).collect()}
    true = {(names[i], names[j]) for i in range(len(fp)) for j in np.flatnonzero(edit_embedding.likeness(fp[i + 1:], fp[i]) >= 0.8) + i + 1}
    assert len(true) >= 500
    found = [root.get(a) is not None and root.get(a) == root.get(b) for a, b in true]
    assert sum(found) >= 0.98 * len(true)
    either = true | {(b, a) for a, b in true}
    assert all((r.a, r.b) in either for r in links.collect())


def test_near_links_hot_bucket_of_copies_and_strangers(spark):
    """One band over equal slots: every fingerprint is in one bucket, most near the least, some only near each other."""
    rng = np.random.default_rng(3)
    base, other = rng.integers(1, 16, (2, edit_embedding.SLOTS)).astype(np.uint8)
    rows = []
    for k in range(300):
        row = (base if k % 3 else other).copy()
        at = rng.choice(np.arange(64, edit_embedding.SLOTS), 10, replace=False)
        row[at] = row[at] % 15 + 1
        row[:64] = base[:64]
        rows.append(row)
    names = edit_embedding.written(np.array(rows))
    links = edit_embedding.near_links(spark.createDataFrame([(x,) for x in names], "fingerprint string"), 0.8, 12, 1, block=32)
    root = {r.node: r.root for r in components(links).collect()}
    groups = [{root[names[k]] for k in range(300) if bool(k % 3) == side} for side in (True, False)]
    like = edit_embedding.likeness(np.array(rows)[1::3], np.array(rows)[0])
    assert like.max() < 0.8 and len(groups[0]) == len(groups[1]) == 1 and groups[0] != groups[1]


def test_banding_widths():
    assert edit_embedding.banding(1.0) == (1, 32)
    for threshold in (0.5, 0.8, 0.9):
        bands, width = edit_embedding.banding(threshold)
        assert bands <= 64 and 1 - (1 - threshold ** width) ** bands >= 0.99


# --- toxicity ----------------------------------------------------------------------------


def test_op5_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in out)
    assert hit > 0.8 * sum(r.toxic for r in out) and sum(r.predicted == 1 and r.toxic == 0 for r in out) <= 5


def test_op5_odd_rows_and_no_labels(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd_docs, none).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows)
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd_docs, labels).count() == len(odd_rows)
    assert toxicity.toxicity(no_docs, labels).collect() == [] and toxicity.drop_toxic(no_docs, labels).collect() == []
    kept = toxicity.drop_toxic(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows)


def test_nnpu_learns_from_positive_and_unlabelled():
    rng = np.random.default_rng(0)
    positive = [np.array([0, rng.integers(2, 50)]) for _ in range(200)]
    unlabelled = [np.array([0 if rng.random() < 0.1 else 1, rng.integers(2, 50)]) for _ in range(1_000)]
    w, b = toxicity.train_nnpu(positive, unlabelled, 50, 0.1)
    assert b + w[0] > 0 > b + w[1]


# --- decontamination ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def benchmark_rows():
    words = [f"word{k}" for k in range(60)]
    return [(1, " ".join(words[:30])), (2, " ".join(words[30:])), (2, " ".join(words[30:])), (3, None), (4, ""), (5, "too short an item"), (None, " ".join(f"x{k}" for k in range(14)))]


def test_op4_planted_and_odd(spark, odd_docs, benchmark_rows, no_docs):
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    w = [f"word{k}" for k in range(60)]
    changed = list(w)
    changed[5], changed[15], changed[24] = "other", "words", "here"
    docs = spark.createDataFrame([
        (1, "before " + " ".join(w[:30]) + " after"), (2, "Before; " + " ".join(changed[:30]).upper().replace(" ", ", ")), (3, " ".join(w[:10])),
        (4, " ".join(reversed(w))), (5, " ".join(w[24:36])), (6, None), (7, " ".join(f"x{k}" for k in range(14))), (None, " ".join(w[30:]))],
        "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontam.decontaminate(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, None), (None, 2)} and got[(1, 1)] == 20
    assert decontam.decontaminate(odd_docs, bench).collect() == []
    assert decontam.decontaminate(no_docs, bench).collect() == [] and decontam.decontaminate(docs, bench.limit(0)).collect() == []
    kept = decontam.drop_leaks(docs.union(docs.filter("doc_id = 4")), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 4, 4, 5, 6])


def test_op4_matches_its_sql(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(decontam.SQL).fetchall()
    assert want and sorted(tuple(r) for r in decontam.decontaminate(docs, bench).collect()) == sorted(want)


def test_excerpts_of_items(spark):
    """Excerpts of 11 to 15 words from inside an item, exact or with a word changed, are found; eight equal words are not."""
    rng = np.random.default_rng(9)

    def words(n):
        return [f"v{x}" for x in rng.integers(0, 10**6, n)]
    item = words(60)
    rows = [words(80) + item[20:20 + n] + words(80) for n in (11, 12, 13, 14, 15)]
    changed = item[20:35]
    changed[7] = "changed"
    rows += [words(80) + changed + words(80), words(80) + item[20:28] + words(80), words(160)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()} == {6, 7}
    got = {r.doc_id: (r.first_word, r.end_word) for r in decontam.decontaminate(docs, bench).collect()}
    assert set(got) == set(range(6)) and all(got[k][0] <= 80 and got[k][1] >= 91 + k for k in range(5))
    assert all(80 - got[k][0] <= 2 and got[k][1] - (91 + k) <= 2 for k in range(5))  # a fifth may differ at the ends


def test_every_excerpt_of_the_given_items(spark):
    """13 words from the inside of each given benchmark item, between other words; and a bitmap of more bits."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rng, rows = np.random.default_rng(4), []
    for r in bench.collect():
        w = re.sub(r"[^\w]+", " ", r.text.lower()).split()
        if len(w) >= 21:
            a = int(rng.integers(4, len(w) - 16))
            out = [f"q{x}" for x in rng.integers(0, 10**6, 60)]
            rows.append((r.item_id, " ".join(out[:30] + w[a:a + 13] + out[30:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in decontam.decontaminate(docs, bench).filter("doc_id = item_id").collect()}
    assert len(rows) >= 20 and found == {k for k, _ in rows}
    assert [decontam._bits(n) for n in (0, 1 << 17, (1 << 17) + 1, 1 << 30)] == [20, 20, 21, decontam.MOST_BITS]


def test_more_seeds_than_the_least_bitmap_holds(spark):
    """Excerpts of items of over 2 ** 17 seeds together, which take a wider bitmap, are all found and their documents dropped."""
    items = [[f"w{i}x{k}" for k in range(110)] for i in range(1_400)]
    rows = [(i, " ".join([f"a{i}"] * 9 + items[i][40:51] + [f"b{i}"] * 9)) for i in range(0, 1_400, 10)]
    docs = spark.createDataFrame([*rows, (-1, " ".join(f"q{k}" for k in range(40)))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert decontam._bits(100 * len(items)) > decontam.BITS
    got = {(r.doc_id, r.item_id): (r.first_word, r.end_word) for r in decontam.decontaminate(docs, bench).collect()}
    assert set(got) == {(i, i) for i, _ in rows} and all(a <= 9 and b >= 20 for a, b in got.values())
    assert [r.doc_id for r in decontam.drop_leaks(docs, bench).collect()] == [-1]


# --- licences ----------------------------------------------------------------------------


def test_op7_planted_lines(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    lines = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
             "Licensed under the Apache License, Version 2.0."]
    want = {(r.doc_id, k) for r in docs.collect() for k, x in enumerate(r.text.split("\n")) if x in lines}
    found = licenses.licenses(docs).collect()
    assert {(r.doc_id, r.paragraph) for r in found} == want and all(r.template in lines for r in found)


def test_op7_odd_rows(odd_docs, no_docs):
    found = licenses.licenses(odd_docs).collect()
    assert [(r.doc_id, r.paragraph, r.family) for r in found] == [(22, 0, "Apache-2.0")]
    assert licenses.licenses(no_docs).collect() == []


# Public notices as they stand in source files.
NOTICES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
           'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                  'License. You may obtain a copy of the License at',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
               "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
               "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                "License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
               "with this file, You can obtain one at",
    "GPL": "You should have received a copy of the GNU General Public License along with this program. If not, see",
}


def plain_share(template, window):
    """A template's share of a text by itself, in plain Python."""
    def grams(text):
        words = re.findall(r"[^\W_]+", text.lower())
        return {" ".join(p) for p in zip(words, words[1:])} if len(words) > 1 else set(words)
    want = grams(template)
    return len(want & grams(window)) / len(want)


def test_op7_wrapped_notices(spark):
    """Notices wrapped at 60 to 80 columns behind comment marks, after a text's own lines and alone."""
    docs = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").filter("text NOT LIKE '%icense%'").limit(300).collect()
    rows, want, k = [(r.doc_id, r.text) for r in docs], {}, 10 ** 6
    for width in (60, 72, 80):
        for mark in ("", "# ", " * "):
            for family, notice in NOTICES.items():
                before = docs[k % len(docs)].text.split("\n")[:3] if mark != "# " else []
                lines = [mark + x for x in textwrap.wrap(notice, width)]
                assert len(lines) > 1
                rows.append((k, "\n".join([*before, *([mark] if k % 2 else []), *lines, "", "The end of it."])))
                want[k] = (len(before) + k % 2, family, notice)
                k += 1
    found = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_id = {i: [r for r in found if r.doc_id == i] for i in want}
    assert all(r.doc_id in want for r in found)
    right = [i for i in want if (want[i][1] in {r.family for r in by_id[i]}) and all(r.family == want[i][1] for r in by_id[i])]
    assert len(right) == len(want) == 72, [(want[i], by_id[i]) for i in want if i not in right][:5]
    assert all(r.template_share == round(plain_share(r.template, want[r.doc_id][2]), 6) for r in found if r.template_share == 1)
    assert sum(len(by_id[i]) for i in right) <= 1.3 * len(right)


def test_op7_versions_and_repeats(spark):
    line = "This work is licensed under the GNU General Public License, version {}."
    docs = [(1, line.format(2)), (2, line.format(3)), (3, line.format(3) + "\n" + line.format(3)), (3, line.format(3)), (4, "\n\n" + line.format(2) + "\n\n"), (5, line.format(7))]
    docs += [(100 + k, f"Plain words of text number {k} stand here.\nNothing else is said.") for k in range(40)]
    found = licenses.licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found) == [
        (1, 0, "GPL-2.0"), (2, 0, "GPL-3.0"), (3, 0, "GPL-3.0"), (3, 0, "GPL-3.0"), (3, 1, "GPL-3.0"), (4, 2, "GPL-2.0")]
