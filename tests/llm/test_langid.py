import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessellar.llm import langid
from tessellar.llm.common import text_buffers
from tessellar.llm.queries import op3_language_id, table

SF = "/root/testdata/sf0.01"


def spectrum(text):
    """The n-grams of lengths 1 to 3, one by one."""
    raw = langid.folded(np.frombuffer(text.encode(), np.uint8)).tobytes()
    return {raw[k : k + n] for n in (1, 2, 3) for k in range(len(raw) - n + 1)}


def test_kernel_is_that_of_the_sets():
    texts = ["The cat sat", "le chat était là", "Ö", "", "the mat"]
    codes, owner = langid.grams(*text_buffers(pa.array(texts)))
    sets = [np.unique(codes[owner == k]) for k in range(5)]
    for s, t in zip(sets, texts, strict=True):
        assert len(s) == len(spectrum(t))
    model = langid.fit_model([sets[0], sets[1], sets[4]], ["en", "fr", "en"], landmarks=3)
    k = model.kernel(*text_buffers(pa.array(texts)))
    landmark = sorted((0, 1, 4), key=lambda i: (("en", "fr", "")[(0, 1, 4).index(i)] == "", -len(sets[i])))
    plain = np.array([[len(spectrum(x) & spectrum(texts[m])) / np.sqrt(max(1, len(spectrum(x))) * len(spectrum(texts[m]))) for m in landmark] for x in texts])
    assert np.allclose(np.sort(k, axis=1), np.sort(plain, axis=1), atol=1e-5)
    assert langid.folded(np.frombuffer("ÉÀ×é".encode(), np.uint8)).tobytes().decode() == "éà×é"


def test_predictions_are_those_of_plain_kernel_ridge_regression():
    r = np.random.default_rng(3)
    words = {"en": "the cat and dog sat on mat with hat".split(), "fr": "le chat et chien était sur là avec où".split(), "de": "der hund und katze saß auf über mit".split()}
    rows = [(name, " ".join(r.choice(own, 6))) for name, own in words.items() for _ in range(8)]
    probes = [*(" ".join(r.choice(own, 4)) + f" zq{k} xyzzy" for own in words.values() for k in range(5)), "q", "", "Ω" * 50]
    codes = [np.unique(langid.grams(*text_buffers(pa.array([t])))[0]) for _, t in rows]
    model = langid.fit_model(codes, [n for n, _ in rows], landmarks=len(rows))
    sets, names = [spectrum(t) for _, t in rows], sorted(words)
    alike = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    k = np.array([[alike(a, b) for b in sets] for a in sets])
    y = np.array([[1.0 if n == name else -1.0 for name in names] for n, _ in rows])
    plain = np.array([[alike(spectrum(t), b) for b in sets] for t in probes]) @ np.linalg.solve(k + langid.RIDGE * np.eye(len(k)), y)
    assert np.allclose(model.margins(*text_buffers(pa.array(probes))), plain, atol=1e-3)


def test_more_languages_than_the_sample(spark):
    docs = spark.createDataFrame([(i, f"word{i} text", f"l{i % 7}") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.train(docs, F.lit(True), sample=3).languages == ["l0", "l1", "l2"]


def test_held_out_accuracy(spark):
    got = op3_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "le chat et le chien", "fr", 2), (3, None, "en", 3), (4, "12 !?", None, 4), (None, "", "de", 5), (5, "x" * 300_000, None, 6), (1, "the cat and the dog", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = langid.identify(docs, langid.train(docs, F.lit(True)))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {(r["doc_id"], r["lang"]): r["lang_pred"] for r in out.collect()}
    assert got[1, "en"] == "en" and got[2, "fr"] == "fr" and got[3, "en"] == got[4, None] == got[None, "de"] == "und" and got[5, None] in ("en", "fr")
    assert langid.train(docs.limit(0), F.lit(True)) is None
    assert [r["lang_pred"] for r in langid.identify(docs.limit(2), None).collect()] == ["und", "und"]
    assert langid.identify(docs.limit(0), None).collect() == []


def test_scripts_of_many_grams_stay_in_bounded_memory():
    """A full sample of random Han, Hangul and Ethiopic letters: hundreds of thousands of n-grams, no matrix of rows by n-grams."""
    import tracemalloc

    r = np.random.default_rng(5)
    first = {"zh": 0x4E00, "ko": 0xAC00, "am": 0x1200}
    width = {"zh": 20_000, "ko": 11_000, "am": 340}
    rows = [(name, "".join(chr(first[name] + int(c)) for c in r.integers(0, width[name], 400))) for name in first for _ in range(2 * langid.SAMPLE // 3)]
    codes = [langid.distinct(*text_buffers(pa.array([t])))[0] for _, t in rows]
    tracemalloc.start()
    model = langid.fit_model(codes, [n for n, _ in rows])
    probe = text_buffers(pa.array([t for _, t in rows[:: len(rows) // 300]]))
    got = model.margins(*probe).argmax(axis=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.vocabulary) > 3 * langid.WIDTH
    assert [model.languages[k] for k in got] == [n for n, _ in rows[:: len(rows) // 300]]
    assert most < 200 << 20  # rows by n-grams in single precision would be five times as much
    assert most < len(rows) * len(model.vocabulary) * 4 / 3
