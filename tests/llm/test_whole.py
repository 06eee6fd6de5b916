"""Cases that a cut of the work would leave out."""

import random
from math import comb

import numpy as np
import pyarrow as pa
from brute import line_classes
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import language, lines, neardup, toxicity
from tallyhouse.session import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _line(name):
    return " ".join(f"{name}{i}word" for i in range(12))


def _after(spark, texts):
    """The texts by id behind the line and copy stages."""
    now = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("lines", "near_duplicates"):
        now = spark.createDataFrame(stages[name](spark, now, "").collect(), DOCS)
    rows = now.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return {r.doc_id: r.text for r in rows}


def test_documents_of_repeats_lose_them(spark):
    a, b, c, d, e, f, g, h = (_line(x) for x in "abcdefgh")
    whole = "\n".join((a, b, c, d, e))
    texts = {
        1: whole,
        2: whole,  # a copy goes whole
        6: whole + "\nand a few words",  # it keeps what is its own
        3: "\n".join((a, b, c, f)),  # three quarters repeat, but it is no copy
        4: "\n".join((g, g, g, h)),  # repeats within
        5: "\n".join((a, f[:-1], g)),  # repeats of several documents only
    }
    after = _after(spark, texts)
    assert after == {1: whole, 3: f, 4: f"{g}\n{h}", 5: "", 6: "and a few words"}
    found = line_classes(list(after.items()), lines.EDITS, lines.SHORTEST)
    assert all(n == 0 and head == at for at, (n, head) in found.items())


def test_short_lines_are_deduped_by_equality(spark):
    a, b, c = (_line(x) for x in "abc")
    texts = {1: f"{a}\nYes.\n\n 短い行。\nYes", 2: f"{b}\nYes. \n\n短い行。", 3: f"Yes.\n{c}\nNo."}
    assert _after(spark, texts) == {1: texts[1], 2: f"{b}\n", 3: f"{c}\nNo."}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.line_no): (r.n_links, r.class_doc_id, r.class_line_no) for r in lines.line_classes(spark, rows, all_lines=True).collect()}
    assert found == {
        (1, 0): (0, 1, 0), (1, 1): (0, 1, 1), (1, 3): (0, 1, 3), (1, 4): (0, 1, 4),
        (2, 0): (0, 2, 0), (2, 1): (0, 1, 1), (2, 3): (0, 1, 3),
        (3, 0): (0, 1, 1), (3, 1): (0, 3, 1), (3, 2): (0, 3, 2),
    }


def test_unlearned_languages_are_rejected_at_any_length(spark):
    rng = random.Random(2)
    text = lambda signs, n: " ".join("".join(rng.choices(signs, k=rng.randint(2, 7))) for _ in range(n))
    known = [(i, text("abdeinorst", 60), "xx") for i in range(70)] + [(100 + i, text("cfghklmpuv", 60), "yy") for i in range(12)]
    odd = [(200, text("αβγδεηικλο", 60), None), (201, text("αβγδεηικλο", 40_000), None)]
    fine = [(300, text("abdeinorst", 40_000), None), (301, text("cfghklmpuv", 40_000), None)]
    table = spark.createDataFrame(known + odd + fine, "doc_id long, text string, lang string")
    model = language.fit(table)
    rows = {r.doc_id: r.accepted for r in language.identify(table, model, {"doc_id": F.col("doc_id")}).collect()}
    assert {i for i, ok in rows.items() if not ok} == {200, 201}
    assert (model.floors > 0).all()


def test_floors_by_band():
    met = np.zeros((language.BANDS, language.STEPS + 1), dtype=np.int64)
    assert not language.floors_of(met).any()
    met[4, 500], met[6, 800], met[8, 700] = 60, 60, 3
    # thin long bands count with the last full one, thin short ones take half of the next
    assert np.allclose(language.floors_of(met), [0.14 / 16, 0.14 / 8, 0.14 / 4, 0.14 / 2, 0.14, 0.14, 0.28, 0.28, 0.28, 0.28])
    met[:] = 0
    met[5, 600] = 10
    assert np.allclose(language.floors_of(met), [0.12 / 32, 0.12 / 16, 0.12 / 8, 0.12 / 4, 0.12 / 2, 0.12, 0.12, 0.12, 0.12, 0.12])


def test_the_chance_of_loss_holds_at_every_threshold():
    for percent in range(25, 100):
        p, need = percent / 100, neardup.need_of(percent)
        assert 1 <= need <= neardup.NEED
        assert sum(comb(neardup.K, n) * p**n * (1 - p) ** (neardup.K - n) for n in range(need)) < 1e-5
    assert (neardup.need_of(80), neardup.need_of(85)) == (25, 28)


def test_a_pair_with_few_common_values_is_linked(spark):
    """Jaccard 0.8, but 26 of the union's 48 least values are common."""
    words = [f"w{i}" for i in range(600)]
    words.sort(key=dict(zip(words, (int(s[0]) for s in neardup.shingle_sets(pa.array(words), 1)), strict=True)).get)
    apart = words[:22] + words[-98:]
    common = words[22:-98]
    rows = [(i, " ".join(common + apart[i - 1 :: 2])) for i in (1, 2)]
    found = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {(1, 540, 1), (2, 540, 1)}


def test_repeated_rows_are_one_of_the_sample_with_their_number(spark, monkeypatch):
    rows = [(i, f"word{i} other{i % 7}", "xx") for i in range(600)] + [(7000 + k, "one text", "xx") for k in range(3) for _ in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keyed = table.withColumn("key", F.xxhash64("doc_id", "text"))
    found = language.chosen_rows(keyed, 60).collect()
    assert sorted((r.doc_id, r.mass) for r in found if r.doc_id >= 7000) == [(7000, 10.0), (7001, 10.0), (7002, 10.0)]
    assert 10 <= len(found) <= 60 and all(r.mass == 1 for r in found if r.doc_id < 7000)

    seen = []
    fit = toxicity.fit_classifier
    monkeypatch.setattr(toxicity, "fit_classifier", lambda rows, target, size, mass=None: seen.append((rows, mass)) or fit(rows, target, size, mass=mass))
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 600, 3)], "doc_id long, toxic int")
    assert toxicity.score(spark, table, labels, F.lit(False), sample=60).count() == len(rows)
    taken, mass = seen[0]
    assert len(taken) == len({tuple(r) for r in taken}) <= 60 and mass.max() >= 30


def test_mass_is_repetition():
    rng = np.random.default_rng(3)
    rows, target, mass = [rng.choice(9, 3, replace=False) for _ in range(20)], rng.random(20), rng.integers(1, 5, 20)
    again = np.repeat(np.arange(20), mass)
    want = toxicity.fit_classifier([rows[i] for i in again], target[again], 9)
    assert np.allclose(toxicity.fit_classifier(rows, target, 9, mass=mass.astype(float)), want)


def _edited(rng, line, edits):
    for _ in range(edits):
        at, what = rng.randrange(len(line)), rng.randrange(3)
        line = line[:at] + ("" if what == 0 else rng.choice("abcdefgh")) + line[at + (what < 2) :]
    return line


def test_line_classes_without_all_pairs(spark):
    rng = random.Random(5)
    texts = []
    for size, edits in ((60, 1), (60, 2), (60, 3), (40, 5)):  # with three edits and more a list falls into open parts
        seed = "".join(rng.choice("abcdefgh ") for _ in range(45)).strip() + "x"
        texts += [_edited(rng, seed, rng.randint(0, edits)) for _ in range(size)]
    rng.shuffle(texts)
    rows = [(i, "\n".join(texts[i : i + 4])) for i in range(0, len(texts), 4)]
    want = line_classes(rows, lines.EDITS, lines.SHORTEST)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for counted in (True, False):
        found = lines.line_classes(spark, table, count_links=counted).collect()
        assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in found} == {p: h for p, (_, h) in want.items()}
        if counted:
            assert {(r.doc_id, r.line_no): r.n_links for r in found} == {p: n for p, (n, _) in want.items()}


def test_a_family_of_lines_makes_few_links(spark, monkeypatch):
    seed, rng = "the same notice stands below a great many of these documents, with one sign changed", random.Random(7)
    texts = sorted({_edited(rng, seed, 1) for _ in range(20_000)} | {seed})
    made = {}

    def watched(session, df, name):
        out = materialize(session, df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "materialize", watched)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lines.line_classes(spark, table, count_links=False)
    assert {r.class_doc_id for r in found.select("class_doc_id").distinct().collect()} == {0}
    assert made["line-pairs"] <= 4 * len(texts)
