import re
from collections import Counter

from ledgerline.llm import quality_rules
from ledgerline.llm.staging import read

SCHEMA = "doc_id long, text string, lang string, words string, common string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def check(got, texts):
    for r in got:
        expected = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)


def test_measures_against_brute_force(spark, data):
    texts = {r.doc_id: r.text for r in read(spark, data, "documents").collect()}
    check(quality_rules.rate(read(spark, data, "documents")).collect(), texts)


def test_edge_texts(spark):
    texts = {
        1: None, 2: "", 3: " \t\n\x0b\x0c\r", 4: "a " * 50, 5: "\n".join(["line one", "line one", " ", " ", "x"]), 6: "one two three four five six seven eight " * 3 + "end",
        7: "ünï code 🙂 " * 30, 8: " ".join(f"w{k}" for k in range(30_000)), 9: "a b c d e f g h " * 5000, 10: "<|#*$%&>" * 100,
    }
    langs = {1: None, 2: "xx"}
    docs = spark.createDataFrame([(k, t, langs.get(k, "en"), "", "") for k, t in texts.items()], SCHEMA)
    got = quality_rules.rate(docs).collect()
    assert len(got) == len(texts)
    check(got, texts)
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_odd_distributions_go_and_prose_stays(spark):
    prose = "The house by the river was built in the spring and it is the oldest of the town with walls that stand for ever. "
    texts = [prose * 1 + f"Number {k} of this row is to be read by all that came on foot and to the end of it with care." for k in range(40)]
    table = " | ".join(f"cell{k}" for k in range(120))
    docs = spark.createDataFrame([(k, t, "en", "", "") for k, t in enumerate(texts)] + [(99, table.upper() + " %%% ### $$$" * 20, "en", "", "")], SCHEMA)
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert kept == set(range(40))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.rate(empty).count() == 0
    assert quality_rules.keep_good(empty).count() == 0


CLEAN = "The house stands near old river banks and boats carry heavy stones to market towns, where people trade bread, wool, candles in winter. "
GERMAN = "Der Mann geht heute durch alte Gassen und sieht viele Boote, die Frau wartet lange in einer Stube, weil sein Bruder den Wagen holt. "


def test_verdict_does_not_depend_on_the_other_rows(spark):
    symbols = " ".join(f"w### o{k}$$$ th%%% an&&&" for k in range(60))
    clean = [(k, CLEAN * 1 + f"Some{k} walls of stone were painted white for visitors, that nobody counted over {k} summers of rain. " + f"Gate{k} is open. " * 2, "en", "", "") for k in range(10)]
    junk = [(100 + k, symbols + f" x{k}", "en", "", "") for k in range(30)]
    alone = [(200, symbols, "fr", "", ""), (201, symbols, None, "", ""), (202, symbols, "xx", "", "")]
    docs = spark.createDataFrame(clean + junk + alone, SCHEMA)
    rated = {r.doc_id: r for r in quality_rules.rate(docs).collect()}
    assert not any(r.base_failed for r in rated.values())
    assert {k for k, r in rated.items() if r.kept} == set(range(10))
    # A row by itself gets the same distances.
    (one,) = quality_rules.rate(spark.createDataFrame(alone[1:2], SCHEMA)).collect()
    assert one == rated[201]


def test_unknown_languages_take_the_nearest_reference(spark):
    docs = spark.createDataFrame([(1, GERMAN, "de", "", ""), (2, GERMAN, None, "", ""), (3, GERMAN, "xx", "", ""), (4, CLEAN, "en", "", ""), (5, CLEAN, None, "", "")], SCHEMA)
    got = {r.doc_id: (r.class_distance, r.word_distance) for r in quality_rules.rate(docs).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5]


RUSSIAN = "Утром мы вышли из дома и долго шли по старой дороге к реке, где вода была тёмной и холодной. Вечером соседи рассказывали о том, как раньше в деревне жили большие семьи, работали в поле и пели песни до самой ночи. "
ITALIAN = "La mattina siamo usciti di casa e abbiamo camminato a lungo verso il fiume, dove l'acqua era scura e fredda. La sera i vicini raccontavano come una volta nel paese vivevano famiglie numerose, che lavoravano nei campi e cantavano fino a tardi. "


def test_clean_texts_in_other_languages_stay(spark):
    texts = [" ".join(w + w[::-1] + w[::2] + w[1::2] + w[::3]) for w in (RUSSIAN.split(), ITALIAN.split())]
    rows = [(k, t, lang, "", "") for k, (t, lang) in enumerate([(texts[0], "ru"), (texts[1], "it"), (texts[1], None), ("table | of | cells | " * 3 + " | ".join(f"c{x}" for x in range(60)), "ru")])]
    got = {r.doc_id: r for r in quality_rules.rate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k].n_words >= 100 and not got[k].base_failed for k in range(3))
    assert [got[k].kept for k in range(4)] == [True, True, True, False]


def test_short_tables_and_word_runs_go(spark):
    names = [f"{a}{b}" for a in ("walt", "gorm", "pell", "rund", "sten", "harv", "mild", "torb") for b in ("en", "ia", "or", "us", "el")]
    texts = {1: " | ".join(names) + ".", 2: " ".join(f"{w} " * 6 for w in names[:6]), 3: " ".join(w + "%%%" for w in names[:30]), 4: CLEAN + "That is what people told us."}
    docs = spark.createDataFrame([(k, t, "en", "", "") for k, t in texts.items()], SCHEMA)
    rated = {r.doc_id: r for r in quality_rules.rate(docs).collect()}
    assert not any(r.base_failed for r in rated.values())
    assert {k for k, r in rated.items() if r.kept} == {4}


def test_references_are_fitted_on_labelled_rows(spark, monkeypatch):
    small = "/root/testdata/sf0.01"
    docs, labels = read(spark, small, "documents"), read(spark, small, "labels")
    got = {r.language: (r.fine_classes, r.common, r.shapes) for r in quality_rules.fit_references(docs, labels).collect()}
    assert got == quality_rules.REFERENCES
    monkeypatch.setattr(quality_rules, "MOST_LABELLED", 5)
    few = {r.language: sum(r.common) for r in quality_rules.fit_references(docs, labels).collect()}
    assert set(few) == set(got) and all(few[c] < sum(got[c][1]) for c in few)
    assert quality_rules.fit_references(docs.limit(0), labels).count() == 0


def test_a_lone_junk_document_goes(spark):
    """Nothing else in the table, so only fixed references can tell."""
    for lang in ("en", None):
        docs = spark.createDataFrame([(1, " ".join(f"##{k} $$ %%{k}" for k in range(70)), lang, "", "")], SCHEMA)
        (row,) = quality_rules.rate(docs).collect()
        assert not row.base_failed and not row.kept


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, CLEAN + "That is what people told us.", "en", "", ""), (3, CLEAN + "That is what people told us.", None, "", ""), (3, CLEAN + "That is what people told us.", None, "", ""), (None, None, None, None, None)]
    got = quality_rules.rate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.kept) for r in got), key=repr) == sorted([(None, True), (3, True), (3, True), (None, False)], key=repr)
