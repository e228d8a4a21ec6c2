import random
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fidelmill.functions import codes, distance, morph, normalize, script, translit


def one(spark, column, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return d.select(column.alias("x")).first().x


def table(spark, column, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in d.select("i", column.alias("x")).orderBy("i").collect()]


T = F.col("t")


@pytest.mark.parametrize(
    "latin, want",
    [("selam", "ሰላም"), ("selam::", "ሰላም።"), ("selam:lehulum", "ሰላም፡ለሁሉም"), ("selam,", "ሰላም፣"), ("selam;", "ሰላም፤"), ("3.14", "3.14"), ("she che tse zhe nye", "ሸ ቸ ጸ ዠ ኘ"), ("a", "አ"), ("1998", "1998"), ("lE lu l", "ሌ ሉ ል"), ("", "")],
)
def test_transliteration(spark, latin, want):
    assert one(spark, translit.transliterate(T), t=latin) == want == translit.transliterate_text(latin)


def test_transliteration_is_the_same_in_both_forms(spark):
    alphabet = "helHmSrsxqQbvtcXnkKw`zZydDjgGTCPfpuiaEIoA:,;?-. WaT1\n"
    import random

    r = random.Random(4)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(400)]
    assert table(spark, translit.transliterate(T), texts) == [translit.transliterate_text(t) for t in texts]


def test_numerals(spark):
    d = spark.range(1, 20_001).select("id", script.numeral(F.col("id")).alias("n"))
    assert d.where(script.numeral_value(F.col("n")) != F.col("id")).count() == 0
    assert table(spark, script.numeral_value(T), ["፩", "፲፩", "፳፻፸፭", "፻", "፼", "ሰላም", ""]) == [1, 11, 2075, 100, 10000, None, None]
    assert one(spark, script.numeral(F.col("v")), v=99_999_999) is not None and one(spark, script.numeral(F.col("v")), v=0) is None


def test_folding(spark):
    assert table(spark, script.fold(T), ["ሠላም", "ሃይል", "ኃይል", "ዐለም", "ፀሐይ", "abc"]) == ["ሰላም", "ሀይል", "ሀይል", "አለም", "ጸሀይ", "abc"]
    assert one(spark, script.fold(script.fold(T)), t="ሠላም ኃይል") == one(spark, script.fold(T), t="ሠላም ኃይል")
    assert one(spark, script.fold(T, script.STRICT), t="ሠላም") == "ሠላም"
    assert table(spark, script.skeleton(T), ["ቁም", "ቃም", "ሠላም"]) == ["ቀመ", "ቀመ", "ሰለመ"]


def reference_tokens(text):
    """Character by character."""
    out = []
    for c in text:
        if c in script.BREAKS:
            kind = "space"
        elif unicodedata.category(c)[0] == "P":
            kind = "punct"
        elif c in script.DIGITS or c.isdigit():
            kind = "number"
        else:
            kind = "word"
        if out and out[-1][0] == kind:
            out[-1][1] += c
        else:
            out.append([kind, c])
    return [tuple(x) for x in out]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ ሰላም፡።፩²①.,-\n\t\xa0​\U0001e7e0é\U0001f600_$", max_size=30), min_size=1, max_size=20))
def test_tokens(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = d.select("i", F.transform(script.tokens(T), lambda x: F.struct(script.token_kind(x).alias("k"), x.alias("x"))).alias("x")).orderBy("i").collect()
    assert [[(p.k, p.x) for p in r.x] for r in got] == [reference_tokens(t) for t in texts]


def test_sentences_and_ratio(spark):
    assert one(spark, script.sentences(T), t="ሰላም። እንዴት ነህ፧ ok. tail") == ["ሰላም።", "እንዴት ነህ፧", "ok.", "tail"]
    assert table(spark, script.ethiopic_ratio(T), ["ሰላም", "ሰabc", "", "12"]) == [1.0, 0.25, 0.0, 0.0]


def test_usual_characters_between_words_meet_no_long_class(spark):
    text = "".join(f"a{chr(p)}b{chr(p)} " for p in (*range(0x250), *range(0x1340, 0x1390), 0x200B, 0x2019, 0x3001, 0xAB01, 0x1E7E0))
    assert one(spark, script.words(T), t=text) == re.findall(script.python_word_pattern(), text)
    for c in " \n,.-12\u1361\u1362\u1369":
        ruled_out = re.search(r"\(\?!(\[.*?\])\)", script.fast_word_pattern())[1]
        assert re.match(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", ruled_out), c)


def test_deletion_keys(spark):
    assert set(one(spark, script.deletion_keys(T), t="ሰላም")) == {"ላም", "ሰም", "ሰላ"}
    assert table(spark, script.deletion_keys(T), ["a", "", "x" * 25]) == [[], [], []]


@pytest.mark.parametrize(
    "modern, before, after",
    [(True, "ሠላም", "ሰላም"), (True, "ዐለም", "አለም"), (True, "ኀይል", "ሀይል"), (True, "ፀሐይ", "ጸሀይ"), (True, "ኃይል", "ሃይል"), (True, "ሰላም፡ለሁሉም", "ሰላም ለሁሉም")]
    + [(False, f"ሰላ{c}ም", "ሰላም") for c in "​‌‍﻿­"]
    + [(False, "ሰላም ነው::", "ሰላም ነው።"), (False, "ሰላም    ነው", "ሰላም ነው"), (False, "ሰላም፡፡ነው", "ሰላም። ነው"), (False, "ሰላም, ነው", "ሰላም፣ ነው"), (False, "see: x", "see: x"), (False, "ሰ-\n  ላም", "ሰላም"), (False, "a\r\n\n\n\nb ", "a\n\nb")],
)
def test_normalization(spark, modern, before, after):
    rule = normalize.normalize(T, modern)
    assert one(spark, rule, t=before) == after
    assert one(spark, rule, t=after) == after


def test_rules_can_be_left_out(spark):
    assert one(spark, normalize.normalize(T, True, frozenset({"modern_orthography"})), t="ሠላም፡ነው") == "ሠላም ነው"
    assert one(spark, normalize.count_rule(T, "strip_invisible"), t="a​b​") == 2


def test_orthography(spark):
    assert table(spark, normalize.orthography(T), ["ሰላም፡ለሁሉም፡ነው፡እኔ", "ሰላም ነው", "ሠላም ፀሐይ", ""]) == ["faithful", "modern", "faithful", "modern"]


def test_distances():
    c = distance.Costs()
    assert c.distance("ሰላም", "ሰላም") == 0 and c.distance("ጣይ", "ጠይ") < c.distance("ጣይ", "መይ")
    assert c.distance("ሀ", "ሃ") < c.distance("ሃ", "ሀ")  # a lost mark is likelier than an invented one
    assert c.distance("abcdef", "uvwxyz", 0.9) == float("inf")
    assert c.sub("ሀ", "ሐ") == pytest.approx(0.36) and c.sub("ጸ", "ፀ") == pytest.approx(0.30)
    learned = distance.Costs({("ሰ", "ሸ"): 10})
    assert learned.sub("ሰ", "ሸ") < c.sub("ሰ", "ሸ") and learned.sub("ሸ", "ሰ") == c.sub("ሸ", "ሰ")
    assert c.similarity("", "") == 1 and 0 <= c.similarity("ሰላም", "xyz") <= 1


@given(st.text(alphabet="ሰሸላለም፡ab", max_size=8), st.text(alphabet="ሰሸላለም፡ab", max_size=8))
def test_alignment_spells_both_words(a, b):
    ops = distance.Costs().align(a, b)
    assert "".join(o for _, o, _ in ops) == a and "".join(i for _, _, i in ops) == b


def test_neighbors_are_sorted_and_bounded():
    for c in list(script.syllables())[:60]:
        n = distance.Costs().neighbors(c)
        assert len(n) <= 16 and all(k <= 0.45 for _, k in n) and n == sorted(n, key=lambda p: (p[1], p[0])) and c not in dict(n)


KNOWN = {"ኢትዮጵያ", "ቤት", "ሰው", "መንግሥት", "ተማሪ", "አገር", "መጽሐፍ", "ልጅ", "ከተማ", "ታሪክ"}


CASES = [(p + "ኢትዮጵያ", "ኢትዮጵያ") for p in ("የ", "በ", "ለ", "ከ", "ወደ", "እንደ", "ስለ")] + [
    ("ቤቱ", "ቤት"), ("ቤቴ", "ቤት"), ("ቤታ", "ቤት"), ("መጽሐፉ", "መጽሐፍ"), ("መንግሥታት", "መንግሥት"), ("የኢትዮጵያን", "ኢትዮጵያ"), ("በቤታችን", "ቤት"), ("ከከተማው", "ከተማ"), ("ለልጆች", "ልጅ"),
]
NO_WORDS = "ዘየጠቀ ቅቅቅቅ ዠዠዠ ኺኺን ጨጨጨው ኰኰኰ ፐፐፐን ጏጏጏ".split()


def test_stems(spark):
    for (_, stem), readings in zip(CASES, table(spark, morph.stems(T), [c for c, _ in CASES])):
        assert next(r.stem for r in readings if r.stem in KNOWN) == stem
    (readings,) = table(spark, morph.stems(T), ["እንደኢትዮጵያ"])
    assert next(r.prefixes for r in readings if r.stem in KNOWN) == ["እንደ"]


def test_no_stem(spark):
    for readings in table(spark, morph.stems(T), NO_WORDS):
        assert len(readings) < 500 and not any(r.stem in KNOWN for r in readings)


def test_stem_sets_are_the_stems_of_all_readings(spark):
    words = [c for c, _ in CASES] + NO_WORDS + ["ቤት", "የ", "x", "ለልጆቻቸውና", ""]
    for word, readings in zip(words, table(spark, morph.stems(T), words)):
        assert sorted({r.stem for r in readings}) == (morph.stem_set(word) if word else [])
        assert len({(r.stem, tuple(r.prefixes), tuple(r.suffixes)) for r in readings}) == len(readings)
        assert [len(r.prefixes) + len(r.suffixes) for r in readings] == sorted(len(r.prefixes) + len(r.suffixes) for r in readings)
    assert one(spark, morph.described(morph.stems(T)[1]), t="የቤት") == "የ-ቤት"


def plain_distance(c, a, b):
    """Least cost of turning one word into the other, from the definition, with memory."""
    cost = lambda x: distance.CHEAP.get(x, distance.INDEL)

    @lru_cache(None)
    def least(i, j):
        if not i or not j:
            return sum(map(cost, a[:i])) + sum(map(cost, b[:j]))
        return min(least(i - 1, j) + cost(a[i - 1]), least(i, j - 1) + cost(b[j - 1]), least(i - 1, j - 1) + c.sub(a[i - 1], b[j - 1]))

    return least(len(a), len(b))


@given(st.lists(st.tuples(*[st.text(alphabet="ሰሸላሃሀለም፡abAé,", max_size=7)] * 2), max_size=12))
def test_batches_of_distances_by_definition(pairs):
    c = distance.Costs({("ሰ", "ሸ"): 3, ("é", "a"): 2})
    for (a, b), got in zip(pairs, c.distances(pairs)):
        assert got == pytest.approx(plain_distance(c, a, b))
    for (a, b), ops, got in zip(pairs, c.alignments(pairs), c.distances(pairs)):
        price = {"match": lambda x, y: 0, "sub": c.sub, "del": lambda x, y: distance.CHEAP.get(x, distance.INDEL), "ins": lambda x, y: distance.CHEAP.get(y, distance.INDEL)}
        assert "".join(o for _, o, _ in ops) == a and "".join(i for _, _, i in ops) == b
        assert sum(price[o](x, y) for o, x, y in ops) == pytest.approx(got)


def test_costs_are_kept_as_json():
    c = distance.Costs({("ሰ", "ሸ"): 3, ("a", "b"): 1}, 0.5)
    back = distance.Costs.from_json(c.to_json())
    assert back.seen == c.seen and back.weight == 0.5 and back.sub("ሰ", "ሸ") == c.sub("ሰ", "ሸ") and distance.Costs.from_json("").seen == {}
    assert distance.Costs().sub("a", "A") == 0.3 and distance.Costs().sub("፡", ":") == distance.Costs().sub(":", "፡") == 0.05


@pytest.mark.parametrize("keys", ["selam", "lehulum", "ityoPya", "tsehay", "selam::", "selam:lehulum", "ale::-"])
def test_typing_key_by_key_is_the_batch(keys):
    assert translit.typed_text(keys) == translit.transliterate_text(keys)


def test_typing_rewrites_what_stands():
    t = translit.Typing()
    assert [t.feed(k) for k in "sha"] == [(0, "ስ", True), (1, "ሽ", True), (1, "ሻ", True)]
    t.reset()
    assert t.feed("a") == (0, "አ", True) and t.feed("1") == (0, "", False) and t.feed("lw") == (0, "", False)
    assert translit.typed_text("law") == "ሏ" and translit.typed_text("a b") == "አ ብ"


def test_spelling_by_arrays_cuts_as_the_pattern():
    """Texts spelt together, each as the regular expression cuts it from the left; nulls, empty texts and long ones too."""
    cut, spelt = re.compile(translit.pattern()), translit.token_map()
    r = random.Random(7)
    keys = "sstzhhTSwwaaAWWAeuiEIokKnychq`xX:::---,;? \nlé\U0001e7e0b"
    texts = ["", None, "wawawawa", "lawawaWAwa", "tshtzhsshTSH", "::-:-:---::", "khuwa`ewa", *("".join(r.choice(keys) for _ in range(r.randrange(20))) for _ in range(3000)), "".join(r.choice(keys) for _ in range(codes.CHARACTERS + 9))]
    out = []
    for at, held in codes.parcels(pa.array(texts)):
        assert at == len(out) and (len(held) == 1 or sum(len(t or "") for t in held) <= codes.CHARACTERS)
        got, ends = translit.spelt(*codes.joined(held))
        got = got.tobytes().decode("utf-32-le")
        out += [got[a:b] for a, b in zip([0, *(ends[:-1] + 1)], ends)]
    assert out == [cut.sub(lambda m: spelt.get(m[0], m[0]), t or "") for t in texts]


def test_composition_and_spelling_share_a_worker(spark):
    p = spark.createDataFrame([("selam xe\u0301 A\u030a",), (None,)], "t string").repartition(2)
    p = p.select(normalize.normalize(translit.transliterate(T)).alias("t"))
    assert p._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {x.t for x in p.collect()} == {unicodedata.normalize("NFC", translit.transliterate_text("selam xe\u0301 A\u030a")), None}
