"""Kneser-Ney models against a plain version by dictionaries; letters of all planes."""
import math
import random
from collections import Counter, defaultdict

import numpy as np

from insightframe.llm import language_id

from .helpers import table


def plain_symbols(text):
    out = []
    for c in (text or "").lower():
        c = c if c.isalpha() else ""
        if c or not out or out[-1]:
            out.append(c)
    return out


def plain_model(texts, d=0.75):
    """(language -> p(symbol, three symbols before it)) by interpolated Kneser-Ney."""
    grams = {lang: {4: Counter()} for lang in texts}
    for lang, ts in texts.items():
        for t in ts:
            s = ["", "", ""] + plain_symbols(t)
            for i in range(3, len(s)):
                grams[lang][4][tuple(s[i - 3:i + 1])] += 1
        for n in (3, 2, 1):  # in how many contexts a shorter one stands
            grams[lang][n] = Counter(g[1:] for g in grams[lang][n + 1])
    alphabet = max(2, len({g for lang in grams for g in grams[lang][1]}) + 1)

    def model(lang):
        total, kinds = defaultdict(int), defaultdict(int)
        for n in (2, 3, 4):
            for g, c in grams[lang][n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
        whole = max(1, sum(grams[lang][1].values()))
        least = min(max(d * len(grams[lang][1]) / whole, 1e-9), 1) / alphabet

        def p(g):
            if len(g) == 1:
                known = grams[lang][1][g]
                # a symbol of no language gets an even share
                return max(known - d, 0) / whole + least if any(grams[x][1][g] for x in grams) else 1 / alphabet
            below = p(g[1:])
            if not total[g[:-1]]:
                return below
            return max(grams[lang][len(g)][g] - d, 0) / total[g[:-1]] + min(d * kinds[g[:-1]] / total[g[:-1]], 1) * below
        return p

    return {lang: model(lang) for lang in texts}


def test_models_equal_plain_kneser_ney(spark):
    r = random.Random(12)
    stems = {"aa": ["strasse", "über", "und", "nicht"], "bb": ["the", "and", "house", "river"], "cc": ["河流", "房子", "和"]}
    texts = {lang: [" ".join(r.choice(w) for _ in range(r.randrange(1, 12))) + r.choice(["", "!", " 12"]) for _ in range(15)]
             for lang, w in stems.items()}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)]
    model = language_id.learn(table(spark, rows))
    plain = plain_model(texts)
    assert model.languages == sorted(texts)
    for text in ["the river und", "Strasse! 7", "河流 the", "zzz über", "和", "a"]:
        nats, letters = model.cross_entropy([text])
        s = ["", "", ""] + plain_symbols(text)
        assert letters[0] == sum(1 for x in s[3:] if x)
        for j, lang in enumerate(model.languages):
            want = [math.log(max(plain[lang](tuple(s[i - 3:i + 1])), 1e-12)) for i in range(3, len(s))]
            assert abs(nats[0, j] + sum(want) / len(want)) < 1e-4, (text, lang)


def test_letters_of_all_planes(spark):
    train = [(i, "plain words of a text", "en") for i in range(20)]
    odd = {101: "𝄞𝄞", 102: "𝟎𝟏", 103: "😀 7", 104: "123", 105: "", 106: None}
    known = {201: "words", 202: "𠀀𠀁", 203: "𝐚𝐛", 204: "𞤀"}
    rows = train + [(k, v, None) for k, v in {**odd, **known}.items()]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(table(spark, rows)).collect()}
    assert {got[k] for k in odd} == {"und"} and {got[k] for k in known} == {"en"}
    key, doc = language_id.symbols(["ab", "𝄞", "𠀀"])
    assert np.bincount(doc, weights=(key & np.uint64(0xFFFF)) != 0, minlength=3).tolist() == [2, 0, 1]
