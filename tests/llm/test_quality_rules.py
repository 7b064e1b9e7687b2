"""Base counts against plain Python, and verdicts of clean and spoiled texts."""

import base64
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.common import documents, vocabulary
from brindle.llm.quality_rules import BANDS, COUNTS, SECOND_BANDS, base_counts, fertility, quality_rules, script_of, second_fertility, verdict
from brindle.llm.spans import texts_of, word_spans
from tests.conftest import DATA
from tests.llm.cases import SCHEMA, frame, tables, words

VOCABULARY, SECOND = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken")


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


@given(st.lists(st.text(st.sampled_from("ab é#\n\t日&\r"), max_size=60), max_size=12))
@settings(max_examples=200, deadline=None)
def test_base_counts(texts):
    got = base_counts(*texts_of(pa.array(texts, pa.string())))
    assert [tuple(int(got[c][i]) for c in COUNTS) for i in range(len(texts))] == list(map(brute, texts))


def test_awkward_rows(spark):
    for df, rows in tables(spark):
        got = quality_rules(df, VOCABULARY).collect()
        want = sorted((str(i), *brute(x)) for i, x, *_ in rows)
        assert sorted((str(r.doc_id), *(r[c] for c in COUNTS)) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)
        kept = quality_rules(df, VOCABULARY, carry=True)
        assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
        assert quality_rules(df.drop("lang"), VOCABULARY).count() == len(rows)


def test_verdicts(spark):
    prose = "It was a bright cold day in spring and the clocks in the old town hall had just begun to strike when she came up the hill with her basket full of bread, wondering whether anyone at home would remember what day it was, or care that she had walked so far alone through the rain and the mud of the lower road."
    spoiled = [" ".join(x + "###" for x in prose.split()), " | ".join(prose.split()), "\x91" * 3 + prose.replace("e", "")[:10] + " �͸" * 80, ("x" * 40 + " ") * 60]
    rows = [(i, x, "en", "a", 1) for i, x in enumerate([prose, *spoiled])]
    assert [r.kept for r in sorted(quality_rules(frame(spark, rows), VOCABULARY).collect(), key=lambda r: r.doc_id)] == [True, False, False, False, False]


def test_labels(spark):
    """Documents labelled good pass the method wherever the base passes; most bad ones fail."""
    sf = f"{DATA}/sf0.01"
    got = quality_rules(documents(spark, sf), VOCABULARY).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert all(good) and sum(bad) <= 0.1 * len(bad)


def test_scrambled_text_of_other_scripts_fails(spark):
    r = random.Random(5)
    blocks = {"han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7A3), "arabic": (0x600, 0x6FF), "hebrew": (0x5C0, 0x5FF), "greek": (0x370, 0x3FF), "armenian": (0x530, 0x58F), "devanagari": (0x900, 0x97F), "bengali": (0x980, 0x9FF), "tamil": (0xB80, 0xBFF), "thai": (0xE00, 0xE5B), "mixed": (0x80, 0x7FF)}
    texts = [" ".join("".join(chr(r.randint(*b)) for _ in range(6)) for _ in range(150)) for b in blocks.values()]
    assert script_of(*texts_of(pa.array(texts))) == list(blocks)
    got = quality_rules(frame(spark, [(i, x, None, "a", 1) for i, x in enumerate(texts)]), VOCABULARY).collect()
    assert not any(x.base_failed or x.kept for x in got)


PROSE = {
    "han": ["春天的早晨,老城的钟声刚刚响起,她提着满满一篮面包走上山坡,心里想着家里是否有人还记得今天是什么日子。街道两旁的商店陆续开门。", "春天的早晨,老城的鐘聲剛剛響起,她提著滿滿一籃麵包走上山坡,心裡想著家裡是否有人還記得今天是什麼日子。臺灣的夜市非常熱鬧,遊客絡繹不絕。", "春の朝、古い町の鐘が鳴り始めたころ、彼女はパンでいっぱいの籠を持って坂を上ってきた。家の誰かが今日が何の日か覚えているだろうか。"],
    "hangul": ["봄날 아침 오래된 마을의 종이 막 울리기 시작했을 때 그녀는 빵이 가득한 바구니를 들고 언덕을 올라왔다. 집에 있는 누군가가 오늘이 무슨 날인지 기억할지 궁금했다."],
    "arabic": ["في صباح ربيعي بارد بدأت أجراس المدينة القديمة تدق عندما صعدت التل وسلتها مليئة بالخبز وهي تتساءل هل يتذكر أحد في البيت أي يوم هو هذا اليوم."],
    "hebrew": ["בבוקר אביבי קר החלו פעמוני העיר העתיקה לצלצל כאשר היא עלתה במעלה הגבעה עם סל מלא בלחם ותהתה אם מישהו בבית יזכור איזה יום היום."],
    "greek": ["Ένα κρύο ανοιξιάτικο πρωινό οι καμπάνες της παλιάς πόλης μόλις άρχισαν να χτυπούν όταν εκείνη ανέβηκε τον λόφο με το καλάθι της γεμάτο ψωμί."],
    "armenian": ["Գարնանային ցուրտ առավոտյան հին քաղաքի զանգերը նոր էին սկսել հնչել, երբ նա հացով լի զամբյուղով բարձրացավ բլուրը։"],
    "devanagari": ["वसंत की एक ठंडी सुबह पुराने शहर की घंटियाँ बजने लगी थीं जब वह रोटियों से भरी टोकरी लेकर पहाड़ी पर चढ़ी और सोच रही थी कि क्या घर में किसी को याद होगा।"],
    "bengali": ["বসন্তের এক ঠান্ডা সকালে পুরানো শহরের ঘণ্টা বাজতে শুরু করেছিল যখন সে রুটি ভরা ঝুড়ি নিয়ে পাহাড়ে উঠে এল।"],
    "tamil": ["வசந்த கால காலையில் பழைய நகரத்தின் மணிகள் ஒலிக்கத் தொடங்கின, அவள் ரொட்டி நிறைந்த கூடையுடன் மலையின் மேல் ஏறி வந்தாள்."],
    "thai": ["ในเช้าวันหนึ่งของฤดูใบไม้ผลิ ระฆังของเมืองเก่าเพิ่งเริ่มดังขึ้น เมื่อเธอเดินขึ้นเนินเขาพร้อมตะกร้าที่เต็มไปด้วยขนมปัง"],
}


def test_prose_of_other_scripts_stays_within_its_bands():
    names, texts = zip(*((k, x) for k, xs in PROSE.items() for x in xs), strict=True)
    data, at = texts_of(pa.array(texts))
    spans = word_spans(data, at)
    measures = fertility(data, at, spans, VOCABULARY, base_counts(data, at, spans)["word_chars"])
    assert script_of(data, at) == list(names)
    assert verdict(measures, np.array([BANDS[k] for k in names])).all()


def plain_measures(text, pieces):
    """chars_per_token, byte_share, entropy_share and sign_share word by word, in plain Python."""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    ids = [i for w in found for i in pieces.encode(w)]
    if not ids:
        return [0.0] * 4
    n, times = len(ids), Counter(ids)
    name = lambda i: pieces.id_to_piece(i).replace("\u2581", "")
    bits = -sum(k / n * math.log2(k / n) for k in times.values())
    single = sum(pieces.is_byte(i) for i in ids)
    sign = sum(not pieces.is_byte(i) and bool(name(i)) and not any(c.isalnum() for c in name(i)) for i in ids)
    return [sum(map(len, found)) / n, single / n, bits / math.log2(max(2, min(n, pieces.vocab_size()))), sign / n]


def test_measures_and_verdict_by_plain_python(spark):
    pieces = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    rows = [tuple(r) for r in documents(spark, f"{DATA}/sf0.001").collect()]
    r = random.Random(4)
    rows += [(9000 + i, " ".join("".join(r.choice("aeinrst#*日é1") for _ in range(r.randrange(1, 9))) for _ in range(80)), lang, "s", 1) for i, lang in enumerate(["en", "de", "fr", "es"] * 5)]
    rows += [(9100, words(8, 25_000), "en", "s", 1), (9101, "ab " * 30_000, "en", "s", 1), (9102, None, "en", "s", 1)]
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3), VOCABULARY).collect()}
    verdicts = Counter()
    for i, text, lang, *_ in rows:
        want = plain_measures(text or "", pieces)
        x = got[i]
        assert [x.chars_per_token, x.byte_share, x.entropy_share, x.sign_share] == pytest.approx(want, abs=1e-9)
        low, high, most_bytes, least_entropy, most_signs = BANDS[lang]
        failed = x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words
        assert x.base_failed == failed
        assert x.kept == (not failed and low <= want[0] <= high and want[1] <= most_bytes and want[2] >= least_entropy and want[3] <= most_signs)
        verdicts[failed, x.kept] += 1
    assert len(verdicts) == 3 and verdicts[False, False] > 5


def test_regular_lines_are_told_apart():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    text = f"{word}\n{other}\n{word}\n{other} {word}"
    counts = base_counts(*texts_of(pa.array([text])))
    assert tuple(int(counts[c][0]) for c in COUNTS) == brute(text) and counts["n_dup_lines"].tolist() == [1]


def test_the_second_vocabulary(spark):
    texts = [(k, x) for k, xs in PROSE.items() for x in xs] + [("latin", "plain words of prose"), ("georgian", "ზარებმა რეკვა დაიწყეს")]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(SECOND, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in quality_rules(frame(spark, [(i, x, None, "a", 1) for i, (_, x) in enumerate(texts)]), VOCABULARY, second=SECOND).collect()}
    for i, (k, x) in enumerate(texts):
        if k not in SECOND_BANDS:
            assert got[i].second_chars is None and got[i].second_parts is None
            continue
        tokens = [plain.decode_single_token_bytes(t) for t in plain.encode_ordinary(x)]
        parts = sum("\ufffd" in t.decode(errors="replace") and "\ufffd" not in x for t in tokens)
        assert (got[i].second_chars, got[i].second_parts) == pytest.approx((len("".join(x.split())) / len(tokens), parts / len(tokens)))
        least, most = SECOND_BANDS[k]
        assert got[i].second_chars >= least and got[i].second_parts <= most, k  # prose lies within


def test_the_second_vocabulary_rejects_random_letters(spark):
    r = random.Random(6)
    blocks = {"han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7A3), "arabic": (0x621, 0x64A), "greek": (0x391, 0x3C9), "armenian": (0x561, 0x586), "devanagari": (0x905, 0x939), "tamil": (0xB85, 0xBB9), "thai": (0xE01, 0xE30)}
    for k, (a, b) in blocks.items():
        letters = [chr(c) for c in range(a, b + 1) if chr(c).isalpha()]
        chars, parts = second_fertility(" ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(150)), SECOND)
        assert chars < SECOND_BANDS[k][0] or parts > SECOND_BANDS[k][1], k
