"""Dictionary files, merging and term detection."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sessionmill.operators import detect, lexicon


def rows(frame):
    return {r.word: (r.severity, r.group) for r in frame.collect()}


def write(path, text):
    path.write_text(text)
    return str(path)


def test_built_in():
    words = lexicon.built_in_rows()
    assert len(words) == len({w for w, _, _ in words}) == 91
    assert len({g for _, _, g in words}) == 15
    assert {s for _, s, _ in words} == set(lexicon.SEVERITIES)
    assert ("badass", "mild", "ass") in words and ("dickhead", "strong", "dick") in words


def test_csv(spark, tmp_path):
    path = write(tmp_path / "d.csv", "Word,severity,group\n Hell ,STRONG,\nfoo,loud,bar\n,mild,x\nhell,mild,Heck\n\n")
    custom = lexicon.read(spark, path)
    assert rows(lexicon.merge(custom)) == {"hell": ("mild", "heck"), "foo": ("moderate", "bar")}
    extended = rows(lexicon.build(spark, path))
    assert len(extended) == 92 and extended["hell"] == ("mild", "heck") and extended["shit"] == ("strong", "shit")
    assert rows(lexicon.build(spark, path, "replace")) == {"hell": ("mild", "heck"), "foo": ("moderate", "bar")}
    # Any other mode extends.
    assert len(rows(lexicon.build(spark, path, "whatever"))) == 92


def test_csv_of_words_alone(spark, tmp_path):
    path = write(tmp_path / "w.csv", "one\ntwo\n")
    assert rows(lexicon.merge(lexicon.read(spark, path))) == {"one": ("moderate", "one"), "two": ("moderate", "two")}


@pytest.mark.parametrize("text", ["", "word,severity\n", "a,mild\nb,mild,c,d\n"])
def test_bad_csv(spark, tmp_path, text):
    path = write(tmp_path / "bad.csv", text)
    with pytest.raises(Exception):
        lexicon.merge(lexicon.read(spark, path)).collect()


def test_json(spark, tmp_path):
    path = write(tmp_path / "d.json", '[{"word": "Heck", "severity": "mild"}, {"word": "x", "severity": "", "group": "G"}]')
    assert rows(lexicon.merge(lexicon.read(spark, path))) == {"heck": ("mild", "heck"), "x": ("moderate", "g")}
    for bad in ('[{"word": "x", "severity": "loud"}]', '[{"word": " ", "severity": "mild"}]'):
        with pytest.raises(Exception):
            lexicon.merge(lexicon.read(spark, write(tmp_path / "bad.json", bad))).collect()


def test_large_dictionary(spark, tmp_path):
    path = write(tmp_path / "big.csv", "word\n" + "\n".join(f"term{i}" for i in range(150_000)))
    assert lexicon.read(spark, path).count() == 150_000


def test_quoted_cells(spark, tmp_path):
    path = write(tmp_path / "quoted.csv", 'word,severity,group\n"a""b",mild,"line\nbreak"\n"back\\",strong,x\n')
    rows = {(r.word, r.severity, r.group) for r in lexicon.read(spark, path).collect()}
    assert rows == {('a"b', "mild", "line\nbreak"), ("back\\", "strong", "x")}


def test_empty_array_extends_by_nothing(spark, tmp_path):
    path = write(tmp_path / "none.json", " [ ] ")
    assert lexicon.build(spark, path).count() == lexicon.build(spark).count()


def test_export_and_info(spark, tmp_path):
    lexicon.write_csv(lexicon.built_in(spark), str(tmp_path / "out"))
    again = lexicon.ordered(spark, lexicon.built_in_rows()).drop("position")
    read = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert read.columns == ["word", "severity", "group"]
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, again.collect()))
    assert tuple(lexicon.info(lexicon.built_in(spark), "p.csv", "replace").first()) == (91, "p.csv", "replace")


def emulate(text, words):
    """Both searches in plain Python on the UTF-8 bytes."""
    ranked = sorted((w.encode() for w in words), key=len, reverse=True)
    found = re.compile(rb"\b(" + b"|".join(map(re.escape, ranked)) + rb")\b")
    low = text.lower()
    short = re.sub(r"(.)\1+", r"\1", low, flags=re.S)
    seen, hits = set(), []
    for number, search in ((1, low), (2, short)):
        if number == 2 and search == low:
            break
        for m in found.finditer(search.encode()):
            if m.start() not in seen:
                seen.add(m.start())
                hits.append((number, m.start(), m.group().decode()))
    return hits


PLAIN = [("the", "mild", "a"), ("thee", "mild", "a"), ("of", "strong", "o"), ("hell", "mild", "h"), ("la_", "mild", "l")]
ODD = [("c++", "mild", "c"), ("the", "mild", "t"), ("the end", "strong", "e"), ("@x", "mild", "x"), ("a.b", "mild", "d")]
PIECES = st.sampled_from(
    ["the", "thee", "THE", "of", "off", "hell", "heLL", "la_", "c++", "@x", "a.b", "end", " ", "  ", "é", "_", "\n", "\x01", "x", "ß", "🙂"]
)


def drawn_texts():
    texts = []

    @settings(max_examples=300, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.lists(PIECES, max_size=14))
    def collect(pieces):
        texts.append("".join(pieces))

    collect()
    return texts


def as_frame(spark, words):
    return spark.createDataFrame(words, "word string, severity string, group string")


@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("words", [PLAIN, ODD])
def test_detection_equals_emulation(spark, words, joined):
    texts = drawn_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lexicon = as_frame(spark, words) if joined else words
    got = sorted((r.id, r["pass"], r.start, r.word) for r in detect.detect(frame, lexicon).collect())
    want = sorted((i, *hit) for i, text in enumerate(texts) for hit in emulate(text, [w for w, _, _ in words]))
    assert got == want and len(got) > 100


def test_double_count_behind_a_collapsed_run(spark):
    shit = [("shit", "strong", "shit")]
    frame = spark.createDataFrame([(1, "hello shit"), (2, "shit hello"), (3, "SHIIIT"), (4, ""), (5, None)], "id int, text string")
    counts = {r.id: r["count"] for r in detect.detect(frame, shit).groupBy("id").count().collect()}
    assert counts == {1: 2, 2: 1, 3: 1}
    once = {r.id: r["count"] for r in detect.detect(frame, shit, mode="token").groupBy("id").count().collect()}
    assert once == {1: 1, 2: 1, 3: 1}


def test_long_text(spark):
    frame = spark.range(1).selectExpr("id", "repeat('the xx of ', 100000) AS text")
    assert detect.detect(frame, PLAIN).count() == len(emulate("the xx of " * 100000, [w for w, _, _ in PLAIN]))


def emulate_tokens(text, words):
    """Tokens from the left, at each the longest term, as written before collapsed."""
    def squeeze(t):
        return re.sub(r"(.)\1+", r"\1", t, flags=re.S)

    parts = re.findall(r"[0-9A-Za-z_]+|[^0-9A-Za-z_]", text.lower())
    lead = int(bool(parts) and not re.match("[0-9A-Za-z_]", parts[0]))
    sized = sorted(((len(re.findall(r"[0-9A-Za-z_]+|[^0-9A-Za-z_]", w)), w) for w in words), reverse=True)
    hits, i = [], 0
    while i < len(parts):
        found = [(-n, p, w) for n, w in sized for p, f in ((1, str), (2, squeeze)) if [f(t) for t in parts[i : i + n]] and "".join(map(f, parts[i : i + n])) == w and len(parts[i : i + n]) == n]
        if found:
            n, number, word = min(found)
            hits.append((number, lead + sum(bool(re.match("[0-9A-Za-z_]", t)) for t in parts[:i]), word))
        i += -n if found else 1
    return hits


def test_token_mode_equals_emulation(spark):
    texts = drawn_texts() + ["the  end", "the ennd the end", "c++ c+ cc++", "@xx a.b aa.b", "a" * 70 + " the end " * 200]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r["pass"], r.start, r.word) for r in detect.detect(frame, ODD, mode="token").collect())
    want = sorted((i, *hit) for i, text in enumerate(texts) for hit in emulate_tokens(text, [w for w, _, _ in ODD]))
    assert got == want and len(got) > 300


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_hundred_thousand_entries(spark, shuffled, monkeypatch):
    """Terms with spaces, symbols and accents in a large dictionary, sent around or not; the plan does not hold it."""
    if shuffled:
        monkeypatch.setattr(detect.phrases, "BROADCAST_ROWS", 1000)
    words = [("the end", "mild", "e"), ("the", "mild", "t"), ("é", "mild", "é"), ("a.b", "strong", "d"), ("long term of a term", "mild", "l")]
    large = as_frame(spark, words).unionByName(spark.range(100_000).selectExpr("concat('t', id, ' é') AS word", "'mild' AS severity", "'f' AS group"))
    texts = ["the end of t99999 éx", "téé the a.b", "x long term of a term " * 40, "tt7 é", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = detect.detect(frame, large)
    got = sorted((r.id, r["pass"], r.start, r.word) for r in found.collect())
    near = [w for w, _, _ in words] + ["t99999 é", "t7 é"]
    assert got == sorted((i, *hit) for i, text in enumerate(texts) for hit in emulate(text, near)) and len(got) > 40
    assert len(found._jdf.queryExecution().toString()) < 200_000 and "t500 é" not in found._jdf.queryExecution().toString()


def test_only_tokens_that_open_a_term_become_rows(spark):
    """Texts of many words, the last of which are a term: the dictionary meets a row for each term's opening, not for each token."""
    import pyarrow as pa

    frame = spark.range(20).selectExpr("id", "concat(repeat('a plain word ', 50), 'é the end') AS text")
    found = detect.detect(frame, as_frame(spark, ODD))
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.start, r.word) for r in found.collect()} == {(653, "the end")} and found.count() == 20
    batch = pa.RecordBatch.from_pydict({"_message": [1, 2, 3], "_kept": [{"id": i} for i in range(3)], "pass": [1, 1, 2], "text": ["é the end", "none", "the"]})
    for size in (1 << 20, 1):
        detect.phrases.SLICE_BYTES, before = size, detect.phrases.SLICE_BYTES
        rows = [r for b in detect.phrases._cut([batch], pa.array(["the"], pa.large_string()), 1) for r in b.to_pylist()]
        detect.phrases.SLICE_BYTES = before
        assert [(r["_message"], r["_place"], r["start"], r["_before"], r["_tokens"]) for r in rows] == [(1, 2, 3, " ", ["the", " "]), (3, 0, 0, None, ["the"])]


@pytest.mark.parametrize("mode", ["compat", "token"])
def test_hits_of_a_word_stay_where_they_are_found(spark, mode):
    """A small dictionary is sent to the hits: a word that is in every text does not gather them in one task."""
    texts = spark.range(0, 1000, 1, 8).selectExpr("id", "'the cat' AS text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the texts were many
    try:
        found = detect.detect(texts, [("the", "mild", "article"), ("dog", "mild", "pet")], mode=mode)
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
