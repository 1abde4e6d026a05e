"""The operators on words against brute force, on awkward rows."""

from __future__ import annotations

import os
import random
import string

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pigmenta.llm.decontaminate import contamination, drop_contaminated
from pigmenta.llm.lm import score_texts
from pigmenta.llm.ngram_join import keep_one, linked_groups
from pigmenta.llm.quality import PATTERN, QualityRules, _encoder, _in_band, fertility, judge, keep_good, quality_report, script_of, vocabulary
from pigmenta.llm.substring_dedup import removed_words

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, size string, id_ string, h1 long, key__ string, Empty__ int, `a.b` int"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed=5):
    rng = random.Random(seed)
    passage, long = prose(rng, 70), prose(rng, 9000, 3000)
    near = prose(rng, 200, 5000).split()
    rows = [(0, "", "en"), (1, None, "en"), (2, "  \t\n ", None), (3, "one", "fr"), (4, "One two", "xx"), (5, long, "en"), (6, long, "de"), (7, "x" * 70_000, "en")]
    for i in range(10, 60):
        text = prose(rng, rng.randrange(1, 260))
        if i % 4 == 0:
            text = f"{text} {passage} {prose(rng, 9)}"
        if i % 9 == 0:
            text = text + "\n" + text + "\n\n" + text
        rows.append((i, text, rng.choice(["en", "fr", "de", "es"])))
    for i in range(60, 110):  # near copies, and copies
        copy = list(near)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10_000)}"
        rows.append((i, " ".join(copy), "en"))
    rows += [(200, rows[12][1], "en"), (201, rows[12][1], "en"), (201, rows[12][1], "en"), (None, rows[12][1], "en"), (None, prose(rng, 80), "en"), (None, passage, None), (203, "été Ça \x85   über ÉTÉ x", "fr"), (204, "AB ab Ab aB ab AB ab ab", "en")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, lang, f"s{n % 5}" if n % 7 else None, None, n, n % 2 == 0, str(n), "x", n, "k", 1, 2) for n, (i, t, lang) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def same(found, expected):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_substring_dedup(docs, rows):
    found = removed_words(docs, width=1 << 14).select("doc_id", "n_words", "n_removed", "kept_sha256")
    same([tuple(r) for r in found.collect()], brute.removed([(i, t) for i, t, _ in rows]))


def test_substring_dedup_survives_a_full_sketch(docs, rows):
    found = removed_words(docs, width=1 << 9).select("doc_id", "n_words", "n_removed", "kept_sha256")
    same([tuple(r) for r in found.collect()], brute.removed([(i, t) for i, t, _ in rows]))


def test_removed_ranges_add_up(docs):
    found = removed_words(docs, width=1 << 14)
    wrong = found.withColumn("n", F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["high"] - r["low"])).where("n != n_removed")
    assert wrong.count() == 0


@pytest.mark.parametrize("k,percent,width", [(3, 90, 1 << 16), (5, 80, 1 << 16), (3, 60, 1 << 9)])
def test_ngram_join(docs, rows, k, percent, width):
    found = linked_groups(docs, k=k, percent=percent, width=width).select("id_", "n_shingles", "component_id")
    same([tuple(r) for r in found.collect()], brute.components([(i, t) for i, t, _ in rows], k, percent))


def test_templates(spark):
    """Texts of the same few sentences share every shingle with many others; rounds and filters lose no link."""
    rng = random.Random(2)
    sentences = [prose(rng, 9, 5000) for _ in range(24)]
    rows = [(i, " ".join(rng.sample(sentences, 6))) for i in range(160)]
    rows += [(200 + i, rows[i][1] + f" tail{i}") for i in range(0, 60, 2)] + [(300 + i, rows[i][1].rsplit(" ", 2)[0]) for i in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (60,):
        found = linked_groups(df, k=3, percent=percent).select("id_", "n_shingles", "component_id")
        same([tuple(r) for r in found.collect()], brute.components(rows, 3, percent))


def test_sketches_add_up_in_two_levels(spark):
    from pigmenta.llm.sketch import log_levels, merged_sketch

    df = spark.range(5000, numPartitions=6).select((F.col("id") % 700).alias("k"))
    keys = lambda b: iter([b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
    one, two = (merged_sketch(df, keys, 1 << 12, 2, log_levels, fan).value for fan in (1, 3))
    assert (one == two).all() and one.sum() > 0


def test_bit_sketches_hold_what_plain_counts_say(spark):
    from pigmenta.llm.sketch import bits_at, cells_of, merged_sketch, present, repeated

    width, spread = 1 << 12, np.uint64(0x9E3779B97F4A7C15)
    df = spark.range(3000, numPartitions=6).select((F.col("id") % 1700).alias("k"))
    keys = lambda b: iter([b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) * spread])
    counts = np.zeros(2 * width, dtype=int)
    values = (np.arange(3000) % 1700).astype(np.uint64) * spread
    for r in range(2):
        np.add.at(counts, cells_of(values, r, width).astype(int) + r * width, 1)
    for least, kind in ((1, present), (2, repeated)):
        for fan in (1, 3):
            found = bits_at(merged_sketch(df, keys, width, 2, kind, fan).value, np.arange(2 * width))
            assert (found == (counts >= least)).all()
    assert not merged_sketch(df.where("k < 0"), keys, width, 2, repeated).value.any()


def test_runs_of_windows_are_bounded(docs, rows, monkeypatch):
    from pigmenta.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "RUN_BYTES", 1)
    found = removed_words(docs, width=1 << 9).select("doc_id", "n_words", "n_removed", "kept_sha256")
    same([tuple(r) for r in found.collect()], brute.removed([(i, t) for i, t, _ in rows]))


def test_session_is_left_as_it_is(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    quality_report(docs).count()
    contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count()
    assert spark.conf.get(name) == before


def test_keep_one(docs, rows):
    kept = keep_one(docs, width=1 << 16)
    assert kept.columns == docs.columns
    groups = {}
    for (i, t, _), (_, _, c) in zip(rows, brute.components([(i, t) for i, t, _ in rows], 5, 80), strict=True):
        if brute.words(t):
            groups.setdefault((c, c is None and t), []).append(i)
    ids = [r["doc_id"] for r in kept.where(F.col("text").rlike(r"\S")).select("doc_id").collect()]
    assert len(ids) == len(groups)
    assert set(ids) == {c for c, _ in groups}
    assert kept.where(~F.coalesce("text", F.lit("")).rlike(r"\S")).count() == 3


def test_quality_statistics(docs, rows):
    found = quality_report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    same([tuple(r)[:7] for r in found], [(i, *brute.quality(t)) for i, t, _ in rows])
    assert not any(r["base_failed"] and r["kept"] for r in found)


def test_quality_verdicts(spark, docs, rows):
    """Fertility and verdict of every text against plain tokenising and the rule written out."""
    rules = QualityRules()
    rng = random.Random(11)
    made = [(i, t, lang) for i, t, lang in rows] + [(None, t, lang) for lang, (_, t) in CLEAN.items()]
    made += [(None, t, "en") for t in ("x" * 120_000 + " end", "a  b\t\tc\n\n  d " * 4000, " " * 30_000 + "x" + "\n" * 20_000, "zq9 #! " * 30, "qz" * 700 + " " + "w " * 12, "é" * 60_000)]
    made += [(None, "".join(rng.choice("qxzjkvwy#$%") + rng.choice([" ", "", ""]) for _ in range(n)), rng.choice(["en", "fr", "xx"])) for n in (20, 60, 90, 150, 400, 3000)]
    made += [(None, " ".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3)) for _ in range(n)), "en") for n in (5, 12, 40)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    expected = []
    for i, text, lang in made:
        n, chars, partial, entropy = brute.fertility(text, rules.tokenizer_dir, rules.vocabulary, PATTERN, rules.entropy_window)
        band = rules.bands.get(lang) or rules.scripts.get(script_of(text or ""), rules.default)
        w = rules.prior_tokens
        chars_, partial_, entropy_ = ((n * x + w * m) / (n + w) for x, m in zip((chars, partial, entropy), ((band.min_chars_per_token * band.max_chars_per_token) ** 0.5, band.max_partial_share / 2, (1 + band.min_entropy_share) / 2)))
        good = band.min_chars_per_token <= chars_ <= band.max_chars_per_token and partial_ <= band.max_partial_share and entropy_ >= band.min_entropy_share
        expected.append((i, n, round(chars, 9), round(partial, 9), round(entropy, 9), good and not brute.quality(text)[5]))
    found = [(r["doc_id"], r["n_tokens"], round(r["chars_per_token"], 9), round(r["partial_share"], 9), round(r["entropy_share"], 9), r["kept"]) for r in quality_report(df).collect()]
    same(found, expected)
    verdicts = {e[5] for e in expected if e[1] > 10}
    assert verdicts == {True, False}


def test_quality_bands(spark):
    good = " ".join(["The weather in the valley was quiet and the river ran slowly past the old mill and its garden."] * 1 + [f"Number {i} of the houses stood {i} steps from the {w} road." for i, w in enumerate("long short broad narrow winding paved dusty straight".split())])
    loud = " ".join(f"{w.upper()}XQ!!##" for w in ("zrk vlq wpt xnb qqz jjk vvx wwz zzk pqx " * 6).split())
    df = spark.createDataFrame([(1, good, "en"), (2, loud, "en"), (3, "too short", "en"), (4, good, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in keep_good(df).collect()} == {1, 4}
    strict = QualityRules(prior_tokens=0, bands={}, default=type(QualityRules().default)(min_chars_per_token=50))
    assert keep_good(df, rules=strict).count() == 0


def test_fertility_of_very_long_runs():
    text = "a" * 300_000 + " " * 300_000 + "é" * 1000
    rules = QualityRules()
    assert fertility(text, rules) == pytest.approx(brute.fertility(text, rules.tokenizer_dir, rules.vocabulary, PATTERN, rules.entropy_window))
    assert fertility(" " * 2_000_000 + "x", rules)[0] > 10


PROSE = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(PROSE), reason="no tables")
@pytest.mark.parametrize("lang", ["en", "fr", "de", "es"])
def test_bands_do_not_fall_with_length(lang):
    rules, rng = QualityRules(), random.Random(6)
    texts = sorted(set(pq.read_table(PROSE, columns=["text"], filters=[("lang", "=", lang)])["text"].drop_null().to_pylist()))
    good = judge(pa.array(texts), [lang] * len(texts), rules)["kept"]
    sentences = [s for t, kept in zip(texts, good, strict=True) if kept and len(t) > 500 for s in t.split(". ")]
    clean = ". ".join(rng.choice(sentences) for _ in range(4_000_000 * len(sentences) // sum(map(len, sentences))))
    poor = " ".join(rng.choice("buy cheap pills online now best price here today".split()) for _ in range(400_000))
    assert len(clean) > 3_000_000 < len(clean.encode())
    for n in (20_000, 300_000, len(clean)):
        assert _in_band(*fertility(clean[:n], rules), rules.bands[lang])
    for n in (2_000, 20_000, len(poor)):
        assert fertility(poor[:n], rules)[3] < rules.bands[lang].min_entropy_share


def test_entropy_windows_cover_the_whole_text():
    rules = QualityRules(entropy_window=64)
    rng = random.Random(7)
    text = " ".join(rng.choice(string.ascii_lowercase) for _ in range(30_000)) + " a" * 30_000
    half, whole = fertility(text[:60_000], rules), fertility(text, rules)
    assert whole[0] == 60_000 and whole[3] == pytest.approx(half[3] / 2, abs=0.01)
    ids = _encoder(vocabulary(rules))[0].encode("one two two three three three")
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert fertility("one two two three three three", rules)[3] == pytest.approx(-(share * np.log2(share)).sum() / np.log2(len(ids)))


CLEAN = {
    "hi": ("devanagari", "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। भारत एक विशाल देश है जहाँ अनेक भाषाएँ बोली जाती हैं। सुबह बच्चे स्कूल जाते हैं और शाम को घर लौटकर अपने माता-पिता के साथ भोजन करते हैं। नदी के किनारे एक छोटा सा गाँव है।"),
    "mr": ("devanagari", "सर्व मानवी व्यक्ती जन्मतः स्वतंत्र आहेत व त्यांना समान प्रतिष्ठा व समान अधिकार आहेत. त्यांना विचारशक्ती व सदसद्विवेकबुद्धी लाभलेली आहे व त्यांनी एकमेकांशी बंधुत्वाच्या भावनेने आचरण करावे."),
    "ko": ("hangul", "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 오늘 아침에는 비가 내렸지만 오후가 되자 하늘이 맑아졌다. 아이들은 공원에서 뛰어놀고 어른들은 벤치에 앉아 이야기를 나누었다. 저녁에는 가족과 함께 식사를 하였다."),
    "zh": ("han", "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。人人有资格享有本宣言所载的一切权利和自由,不分种族、肤色、性别、语言、宗教、政治或其他见解。 今天早上下了一场大雨,街道上到处都是积水。孩子们撑着雨伞走路去学校,老人坐在窗边喝茶看报纸。到了下午,天空终于放晴,大家都出来散步。"),
    "ja": ("han", "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。 今朝は雨が降っていましたが、午後になると空が晴れてきました。子供たちは公園で遊び、大人たちはベンチに座って話をしていました。"),
    "th": ("thai", "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ"),
    "ar": (None, "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق، وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء."),
    "he": (None, "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה."),
    "el": (None, "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης."),
    "ru": (None, "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства."),
    "bn": ("bengali", "সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে। তাঁদের বিবেক এবং বুদ্ধি আছে; সুতরাং সকলেরই একে অপরের প্রতি ভ্রাতৃত্বসুলভ মনোভাব নিয়ে আচরণ করা উচিৎ।"),
    "ta": ("tamil", "மனிதப் பிறிவியினர் சகலரும் சுதந்திரமாகவே பிறக்கின்றனர்; அவர்கள் மதிப்பிலும், உரிமைகளிலும் சமமானவர்கள், அவர்கள் நியாயத்தையும் மனச்சாட்சியையும் இயற்பண்பாகப் பெற்றவர்கள்."),
    "te": ("telugu", "ప్రతిపత్తిస్వత్వముల విషయమున మానవులెల్లరును జన్మతః స్వతంత్రులును సమానులును నగుదురు. వారు వివేదనాంతఃకరణ సంపన్నులగుటచే పరస్పరము భ్రాతృభావముతో వర్తింపవలయును."),
    "ka": ("georgian", "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით."),
    "hy": ("armenian", "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով։ Նրանք ունեն բանականություն ու խիղճ և միմյանց պետք է եղբայրաբար վերաբերվեն։"),
    "pl": (None, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."),
    "vi": (None, "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu."),
    "gu": ("gujarati", "પ્રતિષ્ઠા અને અધિકારોની દૃષ્ટિએ સર્વ માનવો જન્મથી સ્વતંત્ર અને સમાન હોય છે. તેમનામાં વિચારશક્તિ અને અંતઃકરણ હોય છે અને તેમણે પરસ્પર બંધુત્વની ભાવનાથી વર્તવું જોઇએ."),
    "pa": ("gurmukhi", "ਸਾਰਾ ਮਨੁੱਖੀ ਪਰਿਵਾਰ ਆਪਣੀ ਮਹਿਮਾ, ਸ਼ਾਨ ਅਤੇ ਹੱਕਾਂ ਦੇ ਪੱਖੋਂ ਜਨਮ ਤੋਂ ਹੀ ਆਜ਼ਾਦ ਹੈ ਅਤੇ ਸੁਤੇ ਸਿੱਧ ਸਾਰੇ ਲੋਕ ਬਰਾਬਰ ਹਨ। ਉਨ੍ਹਾਂ ਸਭਨਾ ਨੂੰ ਤਰਕ ਅਤੇ ਜ਼ਮੀਰ ਦੀ ਸੌਗਾਤ ਮਿਲੀ ਹੋਈ ਹੈ।"),
    "kn": ("kannada", "ಎಲ್ಲಾ ಮಾನವರೂ ಸ್ವತಂತ್ರರಾಗಿಯೇ ಜನಿಸಿದ್ದಾರೆ. ಹಾಗೂ ಘನತೆ ಮತ್ತು ಹಕ್ಕುಗಳಲ್ಲಿ ಸಮಾನರಾಗಿದ್ದಾರೆ. ವಿವೇಕ ಮತ್ತು ಅಂತಃಕರಣಗಳನ್ನು ಪಡೆದವರಾದ್ದರಿಂದ ಅವರು ಪರಸ್ಪರ ಸಹೋದರ ಭಾವದಿಂದ ವರ್ತಿಸಬೇಕು."),
    "ml": ("malayalam", "മനുഷ്യരെല്ലാവരും തുല്യാവകാശങ്ങളോടും അന്തസ്സോടും സ്വാതന്ത്ര്യത്തോടുംകൂടി ജനിച്ചവരാണ്. അന്യോന്യം ഭ്രാതൃഭാവത്തോടെ പെരുമാറുവാനാണ് മനുഷ്യന് വിവേകബുദ്ധിയും മനസ്സാക്ഷിയും സിദ്ധമായിരിക്കുന്നത്."),
    "am": ("ethiopic", "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል።"),
    "km": ("khmer", "មនុស្សទាំងអស់ កើតមកមានសេរីភាព និងសមភាព ក្នុងផ្នែកសេចក្ដីថ្លៃថ្នូរនិងសិទ្ធិ។ មនុស្ស មានវិចារណញ្ញាណនិងសតិសម្បជញ្ញៈជាប់ពីកំណើត ហើយគប្បីប្រព្រឹត្ដចំពោះគ្នាទៅវិញទៅមក ក្នុងស្មារតីភាតរភាពជាបងប្អូន។"),
    "lo": ("lao", "ມະນຸດທຸກຄົນເກີດມາມີສິດເສລີພາບ ແລະ ສະເໝີໜ້າກັນໃນທາງກຽດຕິສັກ ແລະ ທາງສິດ."),
    "my": ("myanmar", "လူတိုင်းသည် တူညီ လွတ်လပ်သော ဂုဏ်သိက္ခာဖြင့် လည်းကောင်း၊ တူညီလွတ်လပ်သော အခွင့်အရေးများဖြင့် လည်းကောင်း၊ မွေးဖွားလာသူများ ဖြစ်သည်။"),
    "si": ("sinhala", "සියලු මනුෂ්‍යයෝ නිදහස්ව උපත ලබා ඇත. ගරුත්වයෙන් හා අයිතිවාසිකම්වලින් සමාන වෙති. යුක්ති අයුක්ති පිළිබඳ හැඟීමෙන් හා හෘදය සාක්ෂියෙන් යුත් ඔවුන් එකිනෙකා වෙත සහෝදරත්වයේ හැඟීමෙන් ක්‍රියා කළ යුතුය."),
}


@pytest.mark.parametrize("lang", CLEAN)
def test_clean_text_of_each_script_is_in_band(lang):
    script, text = CLEAN[lang]
    rules = QualityRules()
    assert script_of(text) == script and script_of("") is script_of("plain") is script_of("é ü 1 。") is None
    numbers = fertility(text, rules)
    assert _in_band(*numbers, rules.scripts.get(script, rules.default))


def test_languages_without_a_band_are_judged_by_script():
    rules = QualityRules()
    hindi, korean = CLEAN["hi"][1], CLEAN["ko"][1]
    found = judge(pa.array([hindi, hindi, korean, korean, hindi]), ["hi", None, "ko", "xx", "en"], rules)
    assert found["kept"] == [True, True, True, True, False]  # a language's own band goes before
    noise = "".join(chr(0x900 + i % 3) + " " for i in range(3000))
    assert judge(pa.array([noise]), ["hi"], rules)["kept"] == [False]


ITEMS = [(1, "w1 w2"), (2, ""), (3, None), (10, "One, TWO!"), (2, "w5")]


def _items(spark, rows):
    passage = next(t for i, t, _ in rows if i is None and t and len(t.split()) == 70)
    data = [*ITEMS, (7, " ".join(passage.split()[5:30]).upper()), (8, " ".join(passage.split()[8:24])), (None, " ".join(passage.split()[40:52]))]
    return data, spark.createDataFrame(data, "item_id long, text string")


@pytest.mark.parametrize("block_words", [2_000_000, 30])
def test_contamination(spark, docs, rows, block_words):
    data, items = _items(spark, rows)
    found = contamination(docs, items, block_words=block_words).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = brute.contamination([(i, t) for i, t, _ in rows], data)
    same([tuple(r) for r in found.collect()], expected)
    clean = drop_contaminated(docs, items, block_words=block_words)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in expected)


def odd_names(df):
    """The same rows with an id and a language whose names hold dots, and a text in another case."""
    return df.toDF(*({"doc_id": "doc.id", "text": "Text", "lang": "a.lang"}.get(c, c) for c in df.columns))


def test_columns_with_any_names(spark, docs, rows):
    odd = odd_names(docs)
    _, items = _items(spark, rows)
    plain = contamination(docs, items).drop("hits", "items")
    same([tuple(r) for r in contamination(odd, items, id_column="doc.id").drop("hits", "items").collect()], [tuple(r) for r in plain.collect()])
    report = quality_report(odd, id_column="doc.id", lang="a.lang")
    assert report.columns[0] == "doc.id"
    same([tuple(r) for r in report.collect()], [tuple(r) for r in quality_report(docs).collect()])
    for found, expected in ((drop_contaminated(odd, items), drop_contaminated(docs, items)), (keep_good(odd, lang="a.lang"), keep_good(docs))):
        assert found.columns == odd.columns
        same([tuple(r) for r in found.collect()], [tuple(r) for r in expected.collect()])


def test_unknown_and_doubtful_columns(spark):
    df = spark.createDataFrame([("a", "b")], "text string, lang string")
    with pytest.raises(ValueError):
        keep_good(df, text="body")
    with pytest.raises(ValueError):
        keep_good(df.toDF("Text", "TEXT"), lang="Text")


def test_contamination_by_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, none).where("contaminated OR n_items > 0").count() == 0
    assert drop_contaminated(docs, none).count() == docs.count()


def test_language_model(docs, rows, monkeypatch):
    from pigmenta.llm import lm

    monkeypatch.setattr(lm, "SPLIT_BYTES", 3000)  # many splits of a partition
    small = docs.where(F.length("text") < 2000).unionByName(docs.where("text IS NULL"))
    found = {(r["doc_id"], r["n_tokens"], round(r["score"], 6)): r for r in score_texts(small.repartition(3)).collect()}
    expected = brute.lm([(i, t) for i, t, _ in rows if t is None or len(t) < 2000])
    assert len({(e[0], e[2], round(e[6], 6)) for e in expected}) == len(found)
    for i, held, n, known, total, base, score in expected:
        r = found[(i, n, round(score, 6))]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_model_prefers_text_like_the_corpus(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice("the river ran past old mill quiet valley road house garden".split()) for _ in range(30))
    texts = [(i, sentence()) for i in range(80)]
    noise = [(1000 + i, "".join(rng.choice("qxzjkvwy") for _ in range(160))) for i in range(8) if brute.is_held_out(1000 + i)]
    found = score_texts(spark.createDataFrame(texts + noise, "doc_id long, text string")).collect()
    by = {r["doc_id"]: r["score"] / max(1, len(dict(texts + noise)[r["doc_id"]])) for r in found if r["held_out"]}
    assert noise and min(v for k, v in by.items() if k < 1000) > max(v for k, v in by.items() if k >= 1000)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for made in (removed_words(empty, width=1 << 10), linked_groups(empty, width=1 << 10), keep_one(empty, width=1 << 10), quality_report(empty), keep_good(empty), contamination(empty, items), drop_contaminated(empty, items), score_texts(empty)):
        assert made.collect() == []
