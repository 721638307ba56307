"""Decontamination, mixture, sentence spans and the pipeline."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import common, decontaminate, jaccard, mixture, quality, spans
from tests.llm.test_jaccard import WORD, shingle_set
from tests.llm.util import docs_frame, rows_of


def text_of(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


# --- decontamination ---


def contained(docs, items):
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        for i, q in items:
            own = shingle_set(q)
            if not own:
                continue
            k = len(next(iter(own)))
            runs = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
            n = len(own & runs)
            if 100 * n >= 75 * len(own):
                out.append((d, i, n, len(own), n / len(own)))
    return sorted(out, key=str)


def test_containment_matches_brute_force(spark):
    rng = random.Random(3)
    items = [(i, text_of(rng, rng.choice([1, 2, 4, 5, 7, 12, 40, 90]))) for i in range(40)] + [(100, None), (101, "  "), (102, "Same Words here again twice now"), (103, "same words here again twice now"), (None, "an item with no id at all")]
    docs = []
    for i in range(120):
        t = text_of(rng, rng.randint(0, 200)).split()
        if i % 2:
            q = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if q:
                    q[rng.randrange(len(q))] = "changed"
            at = rng.randint(0, len(t))
            t[at:at] = q[: rng.randint(len(q) // 2, len(q))]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(t)))
    docs += [(500, None), (501, ""), (502, "x " * 50_000 + "same words here again twice now"), (None, "an item with no id at all"), (1, "an item with no id at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontaminate.contained_items(docs_frame(spark, docs), bench))
    assert got == contained(docs, items)
    df = docs_frame(spark, docs).selectExpr("text", "doc_id", "1 AS item_id", "'c' AS containment")
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns
    hit = Counter((d, t) for d, t in docs if contained([(d, t)], items))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(docs) - hit


def test_containment_in_chunks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_A_CHUNK", 3)
    items = [(i, f"one two three four five {i}") for i in range(10)]
    docs = [(i, f"start one two three four five {i} end") for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontaminate.contained_items(docs_frame(spark, docs), bench)) == contained(docs, items)
    assert rows_of(decontaminate.contained_items(docs_frame(spark, []), bench)) == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(decontaminate.contained_items(docs_frame(spark, docs), none)) == []
    assert decontaminate.clean(docs_frame(spark, docs), none).count() == 12


# --- mixture ---


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague_by_highest_quotients(seed):
    rng = np.random.default_rng(seed)
    votes, caps = rng.integers(0, 500, 9).astype(float), rng.integers(0, 60, 9)
    for seats in (0, 1, 17, 150, 1000):
        want = np.zeros(9, int)
        for _ in range(seats):
            q = [(-votes[i] / (2 * want[i] + 1), i) for i in range(9) if want[i] < caps[i] and votes[i] > 0]
            if not q:
                break
            want[min(q)[1]] += 1
        assert mixture.sainte_lague(votes, seats, caps).tolist() == want.tolist()


def plain_targets(sizes, weights=(3, 1, 2)):
    """Shares by weight, again and again, until no target is above twice its size."""
    w = [float(weights[i % 3]) for i in range(len(sizes))]
    out, left, active = [0.0] * len(sizes), 1.5 * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while active:
        share = {i: left * w[i] / sum(w[k] for k in active) for i in active}
        over = [i for i in active if share[i] > 2 * sizes[i]]
        for i in over or active:
            out[i] = 2.0 * sizes[i] if over else share[i]
        if not over:
            break
        left -= sum(2 * sizes[i] for i in over)
        active = [i for i in active if i not in over]
    return out


def plain_seats(votes, seats, caps):
    got = [0] * len(votes)
    for _ in range(seats):
        q = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if got[i] < caps[i] and votes[i] > 0]
        if not q:
            break
        got[min(q)[1]] += 1
    return got


def test_targets_and_blocks_of_many_sources(spark):
    rng = random.Random(2)
    for sizes in ([100, 1000, 0, 50], [rng.choice([0, 3, 40, 40, 700]) for _ in range(60)], [0], [], [16] * 7):
        names = sorted({f"{rng.random()}{rng.choice(['a', 'é', chr(0x1F600)])}" for _ in sizes}, key=str.encode)
        names = names[:-1] + [None] if names else []
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, n long").repartition(3)
        rows = sorted(mixture.allotted(mixture.targets(mixture.ranked(df))).collect(), key=lambda r: r.sid)
        assert [r.source for r in rows] == names and [r.sid for r in rows] == list(range(len(names)))
        want = plain_targets(sizes)
        assert all(abs(r.target - t) < 1e-6 for r, t in zip(rows, want, strict=True))
        seats = round(sum(want) / mixture.BLOCK)
        assert [r.blocks for r in rows] == plain_seats([r.target for r in rows], seats, [-(-2 * s // mixture.BLOCK) for s in sizes])


def mix_rows():
    rng = random.Random(8)
    rows = [(i, text_of(rng, rng.randint(0, 90)), rng.choice(["a", "b", "b", "b", "\U0001f600", "ü", "z"])) for i in range(600)]
    return rows + [(2000, None, "a"), (2001, "one two", None), (2002, "", None), (5, "again me", "a"), (5, "again me", "a"), (2003, "w " * 20_000, "z"), (None, "no id", "b")]


def test_mixture_meets_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixture.mixture(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    again = mixture.mixture(df.repartition(5)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    goal = dict(zip(order, plain_targets([size[s] for s in order]), strict=True))
    assert abs(sum(goal.values()) - 1.5 * sum(size.values())) < 1e-6
    taken = Counter()
    by_target = {round(v, 6): s for s, v in goal.items()}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[by_target[round(r.target, 6)]] += r.taken
    for s in order:
        assert abs(taken[s] - goal[s]) <= 2 * mixture.BLOCK


@pytest.mark.parametrize(("shard_rows", "broadcast"), [(4000, mixture.BROADCAST_BYTES), (40, 0)])
def test_mixture_rows_are_those_of_a_plain_mix(spark, monkeypatch, shard_rows, broadcast):
    """Quotas, seeded order and stretches by plain lists; only the seeds' hashes come from Spark."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixture, "ROWS_A_SHARD", shard_rows)
    monkeypatch.setattr(mixture, "BROADCAST_BYTES", broadcast)  # sources in the driver, or as a table
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n_shards = -(-len(rows) // shard_rows)
    tie = F.xxhash64("text")
    shard = F.pmod(F.xxhash64(F.lit(mixture.SEED), "doc_id", tie), F.lit(n_shards))
    keyed = df.select("doc_id", "text", "source", tie.alias("tie"), shard.alias("shard"), F.xxhash64(F.lit(mixture.SEED + 1), "doc_id").alias("h")).collect()
    names = sorted({s for *_, s in rows if s is not None}, key=str.encode) + [None]
    by = {}
    for r in keyed:
        by.setdefault((names.index(r.source), r.shard), []).append((r.h, r.doc_id is not None, r.doc_id or 0, len(WORD.findall(r.text or "")), r.tie))
    total = [sum(n for (s, _), group in by.items() if s == i for *_, n, _ in group) for i in range(len(names))]
    goal = plain_targets(total)
    blocks = plain_seats(goal, round(sum(goal) / mixture.BLOCK), [-(-2 * n // mixture.BLOCK) for n in total])
    offs = {(r.sid, r.shard): r.h for r in spark.createDataFrame(sorted(by), "sid long, shard int").select("sid", "shard", F.xxhash64(F.lit(mixture.SEED + 2), "sid", "shard").alias("h")).collect()}
    want = Counter()
    for i in range(len(names)):
        shards = sorted(k for s, k in by if s == i)
        avail = [sum(g[3] for g in by[i, k]) for k in shards]
        for k, n, quota in zip(shards, avail, plain_seats([float(x) for x in avail], blocks[i], [-(-2 * x // mixture.BLOCK) for x in avail]), strict=True):
            line = [j for j, g in enumerate(sorted(by[i, k])) for _ in range(g[3])]  # the document of each word
            due = min(quota * mixture.BLOCK, 2 * n)
            begin = offs[i, k] % max(1, -(-n // mixture.BLOCK)) * mixture.BLOCK
            took = Counter(line[(begin + w) % n] for w in range(due % n)) if n else Counter()
            for j, (_, known, d, size, _) in enumerate(sorted(by[i, k])):
                want[d if known else None, size, total[i], took[j] + (due // n if n else 0) * size] += 1
    got = Counter((r.doc_id, r.size, r.source_size, r.taken) for r in mixture.mixture(df).collect())
    assert got == want


def test_quotas_of_many_shards_in_bounded_groups(spark):
    """Runs of shards first, then their shards: quotas sum to the blocks, none over its cap, each near its share."""
    rng = random.Random(6)
    rows = [(sid, k, rng.choice([0, 5, 40, 300, 5000]), blocks) for sid, blocks in ((0, 900), (1, 20_000), (2, 0)) for k in range(200) if sid < 2 or k < 3]
    df = spark.createDataFrame(rows, "sid long, shard int, avail long, blocks long").repartition(3)
    flat = {(r.sid, r.shard): r.quota for r in mixture.quotas(df, 200).collect()}
    deep = {(r.sid, r.shard): r.quota for r in mixture.quotas(df, 200, 6).collect()}
    assert set(flat) == set(deep) == {(s, k) for s, k, _, _ in rows}
    for sid, blocks in ((0, 900), (1, 20_000), (2, 0)):
        caps = {k: -(-2 * n // mixture.BLOCK) for s, k, n, _ in rows if s == sid}
        for got in (flat, deep):
            assert sum(got[sid, k] for k in caps) == min(blocks, sum(caps.values())) and all(got[sid, k] <= c for k, c in caps.items())
        assert all(abs(flat[sid, k] - deep[sid, k]) <= 3 for k in caps)


def test_mixed_documents_hold_the_taken_words(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "length(text) AS n_chars", "1 AS size", "2 AS shard", "'q' AS target")
    plan = Counter()
    for r in mixture.mixture(df).collect():
        plan[r.doc_id] += r.taken
    out = mixture.mixed(df)
    assert out.columns == df.columns
    got, source = Counter(), {d: t or "" for d, t, _ in rows}
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and (r.doc_id == 5 or set(r.text.split()) <= set(source[r.doc_id].split()))
    assert got == Counter({d: n for d, n in plan.items() if n})
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture.mixture(empty).collect() == [] and mixture.mixed(empty).collect() == []


# --- sentence spans ---


def span_brute(rows, k=spans.SENTENCES, least=spans.LEAST_WORDS):
    """Removes what the operator says it removes, by plain lists."""
    docs = sorted(((d if d is not None else -(2**63)), t or "") for d, t in rows)
    parts = []
    for _, t in docs:
        words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(t)]
        sents, cur = [], []
        for i, (w, s, e) in enumerate(words):
            cur.append((w, s))
            last = i + 1 == len(words)
            if last or w[-1] in ".!?" or "\n" in t[e : words[i + 1][1]]:
                sents.append(([x.translate({c: c + 32 for c in range(65, 91)}) for x, _ in cur], cur[0][1]))
                cur = []
        parts.append(sents)
    seen, out = set(), []
    for (d, t), sents in zip(docs, parts, strict=True):
        gone = set()
        for i in range(len(sents) - k + 1):
            j = i + k
            while j < len(sents) and sum(len(s[0]) for s in sents[i:j]) < least:
                j += 1
            if sum(len(s[0]) for s in sents[i:j]) < least:
                continue
            name = tuple(tuple(s[0]) for s in sents[i:j])
            if name in seen:
                gone.update(range(i, j))
            seen.add(name)
        ends = [s[1] for s in sents[1:]] + [len(t)]
        kept = t
        for i in sorted(gone, reverse=True):
            kept = kept[: sents[i][1]] + kept[ends[i] :]
        out.append((None if d == -(2**63) else d, len(sents), len(gone), len(t.encode()) - len(kept.encode()), kept))
    return sorted(out, key=str)


def test_spans_match_brute_force(spark):
    rng = random.Random(6)
    sentence = lambda: (text_of(rng, rng.randint(1, 45), "abé") + rng.choice([".", "!", "?", "\n", ". ", ".\n", ""]))
    shared = [" ".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(8)]
    rows = []
    for i in range(90):
        rows.append((i, " ".join(rng.choice(shared) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(0, 6)))))
    rows += [(200, None), (201, ""), (202, " \n. "), (203, "word. " * 500), (7, shared[0]), (7, shared[0]), (None, shared[1]), (204, text_of(rng, 3000))]
    rng.shuffle(rows)
    assert rows_of(spans.sentence_span_dedup(docs_frame(spark, rows))) == span_brute(rows)


def test_a_repeated_passage_goes_but_the_first(spark):
    rng = random.Random(1)
    passage = ". ".join(text_of(rng, 13) for _ in range(4)) + "."
    rows = [(i, f"{text_of(rng, 9)}. {passage} {text_of(rng, 9)}.") for i in range(5)]
    got = {r.doc_id: r for r in spans.sentence_span_dedup(docs_frame(spark, rows)).collect()}
    assert passage in got[0].text and got[0].n_removed == 0
    assert all(passage not in got[i].text and got[i].n_removed == 4 for i in range(1, 5))
    four = [(i, f"{i}. One two three four. Five six seven eight. Nine ten eleven twelve. Thirteen to sixteen. {i} more.") for i in range(2)]
    assert [r.n_removed for r in sorted(spans.sentence_span_dedup(docs_frame(spark, four)).collect())] == [0, 4]
    one = text_of(rng, 46)
    clean = [(1, "Short line."), (2, "Short line."), (3, f"Three here. {one}."), (4, f"Four there. {one}.")]
    assert all(r.n_removed == 0 for r in spans.sentence_span_dedup(docs_frame(spark, clean)).collect())
    short = [(i, "Of two sentences. That is all.") for i in range(3)]
    assert [r.n_removed for r in sorted(spans.sentence_span_dedup(docs_frame(spark, short), least=1).collect())] == [0, 2, 2]
    assert [r.n_removed for r in sorted(spans.sentence_span_dedup(docs_frame(spark, short)).collect())] == [0, 0, 0]
    assert spans.sentence_span_dedup(docs_frame(spark, [])).collect() == []


@pytest.mark.parametrize(("length", "least"), [(1, 1), (2, 1), (2, 5), (3, 4), (5, 9), (1, 8)])
def test_runs_of_any_length(spark, length, least):
    rng = random.Random(length)
    pool = [text_of(rng, rng.randint(1, 4), "ab") + "." for _ in range(12)]
    rows = [(i // 2 if i % 9 else None, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    assert rows_of(spans.sentence_span_dedup(docs_frame(spark, rows), length, least)) == span_brute(rows, length, least)


# --- pipeline ---


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows, labels = [], []
    for i in range(240):
        good = i % 5 != 0
        t = text_of(rng, rng.randint(20, 90), "aeinrst")
        rows.append((i, t if good else t.upper().replace(" ", "!! "), "en", f"src{i % 4}", len(t)))
        labels.append((i, int(good), 0))
    copy = rows[1][1]
    rows += [(1000, copy, "en", "src1", len(copy)), (1001, copy + " tail", "en", None, 5), (1002, "a test item of ten words that must not leak " + text_of(rng, 40, "aeinrst"), "en", "src2", 9), (1003, None, None, "src3", None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a test item of ten words that must not leak")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/{i}")
        out = spark.read.parquet(f"{d}/{i}")
        if name != "tokens":
            assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.collect()})
        docs = out
    good = {i for i in range(240) if i % 5}
    assert len(kept[0] & good) > 0.97 * len(good) and len(kept[0] - good - {1000, 1001, 1002, 1003}) < 10
    assert kept[1] == kept[0] - {1000, 1001}
    assert kept[2] == kept[1] - {1002}
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert Counter(corpus_pipeline.run(spark, d).columns) == Counter(["doc_id", "start", "n_tokens", "ids_crc32"])




# --- columns of the caller ---


def test_columns_of_the_caller_keep_their_values(spark):
    """Names that the operators use inside, maps among the columns: names, types and values stay."""
    rng = random.Random(4)
    rows = [(i, text_of(rng, 40), "web", f"mine{i}", f"x{i}", f"n{i}", i * 2, {"a": i}, [{"k": 1}], f"s{i}") for i in range(30)]
    rows += [rows[3], (*rows[4][:3], "other", *rows[4][4:])]
    ddl = "doc_id long, text string, source string, quality_score string, _id string, _name string, _n long, m map<string,int>, deep array<map<string,int>>, QUALITY_SCORE_ string"
    docs = spark.createDataFrame(rows, ddl).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    every = {str(tuple(r)) for r in docs.collect()}
    for got in (quality.keep_good(docs, labels), jaccard.keep_one(docs), decontaminate.clean(docs, spark.createDataFrame([(1, "no such words in any text here")], "item_id long, text string"))):
        assert got.schema == docs.schema
        kept = [str(tuple(r)) for r in got.collect()]
        assert kept and set(kept) <= every
    assert jaccard.keep_one(docs).count() == 30
    known = {r.doc_id: r for r in docs.filter("doc_id <> 4").collect()}
    for r in mixture.mixed(docs).filter("doc_id <> 4").collect():
        assert all(r[c] == known[r.doc_id][c] for c in docs.columns if c != "text")
    with pytest.raises(ValueError):
        quality.score(docs, quality.fit(docs, labels))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no driver tables")
def test_shards_behind_a_join(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    plain = common.plan_bytes(docs.select("doc_id", "text"))
    joined = common.plan_bytes(docs.join(labels, "doc_id", "left").select("doc_id", "text"))
    many = common.plan_bytes(docs.select("doc_id", "text", F.explode(F.array(*[F.lit(1)] * 10))))
    assert joined < 2 * plain and plain < 2 * joined and 8 * joined < many < 12 * joined
    assert common.shard_count(docs.join(labels, "doc_id", "left").select("doc_id", "text")) <= 8
