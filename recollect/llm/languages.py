"""The language of a short text: by script first, then by character n-grams.

Scripts decide for Han, Japanese, Korean, Cyrillic, Greek, Arabic, Hebrew, Thai and Devanagari. For Latin script, the characters
of the padded words (one to four in a row) are scored under one model per language, counted on a list of its frequent words;
the best must beat the language in question by a margin, and a few of the text's words must be frequent ones of it or have
letters that the other lacks, since names of persons and medicines look like no language.
"""

from __future__ import annotations

import math
import re

#: Frequent words, by language.
FREQUENT = {
    "en": "the a an of and or in on at to for with by from as is was were are be been has had have that this which who when while after before not no but so than then their her his its about until despite because since she he they it took felt said pain doctor every day week month years old again more less only between during without into over under out up down did does do will would can could should there here what where why how all any each other some such very most just also",
    "es": "el la los las un una de del y o en con por para que se su al es fue era ya no más pero durante cada sin lo le como muy antes después desde hasta señora señor médico dolor subió tomó noche mañana días semana porque cuando donde también está estaba tiene tenía había sus este esta todo todos entre sobre podía sintió",
    "de": "der die das den dem des ein eine einen einem und oder in im mit von zu zum zur für auf ist war wurde ging aber nicht noch nach bei sie er es ihm ihr wie als auch jeden wegen konnte frau herr schmerzen hatte haben sich wird werden durch über unter zwischen während ohne weil wenn dann sehr mehr wieder morgen abend tag woche gegen",
    "fr": "le la les un une des de du et ou en dans avec pour par que qui se sa son est était au aux il elle mais pas plus après avant chaque sur sans très cette ces leur leurs nous vous ils elles été avait ont sont être fait comme quand jour semaine matin soir douleur médecin madame monsieur depuis pendant entre",
    "pt": "o a os as um uma de do da dos das e ou em no na nos nas com por para que se seu sua foi era mas não mais após antes cada sem muito também está estava tem tinha ele ela eles dor médico senhora senhor dias semana noite manhã quando onde porque até desde entre pelo pela ao à",
    "it": "il lo la gli le i un una uno di del della dei delle e o in nel nella con per che si suo sua è era ma non più dopo prima ogni sono ha aveva hanno anche come quando dove perché molto senza tra fra dal dalla al alla dottore dolore signora signor giorni settimana mattina sera ancora",
    "nl": "de het een van en of in op aan te met voor door uit is was waren zijn heeft had hebben dat die dit niet geen maar dan ook nog na bij zij hij haar hun om als naar over onder tussen tijdens zonder omdat wanneer zeer meer weer elke dag week pijn arts mevrouw mijnheer ochtend avond",
    "pl": "i w na z do nie że się jest był była było są to ten ta te po przed od dla ale o jak przez oraz lub bez przy za co gdy już tylko bardzo więcej znowu każdy każdego dzień tydzień rano wieczorem ból lekarz pani pan jego jej ich może ma miał miała",
    "sv": "och i att det som en ett på är av för med den till inte var har hade de om men så vid efter före under över utan när där hon han hennes hans deras sig eller också mycket mer igen varje dag vecka smärta läkare fru herr morgon kväll kunde från",
    "tr": "ve bir bu da de için ile çok daha sonra önce gibi ama değil olarak olan oldu her gün hafta ağrı doktor hanım bey sabah akşam kadar ne var yok o onun onlar şu en ya veya ki mi ise",
    "ro": "și în de la cu pe un o nu că este era au a fost sunt din pentru mai dar după înainte fără care când unde foarte iar sau ca să se lui ei lor fiecare zi săptămână durere medic doamna domnul dimineața seara",
    "vi": "và của là có không được cho với các một những này khi đã sẽ trong ngoài trên dưới người bà ông bị đau bác sĩ ngày tuần sáng tối rất hơn lại mỗi sau trước vì nhưng",
    "id": "dan yang di ke dari untuk dengan tidak ini itu adalah pada dalam akan sudah telah karena tetapi setelah sebelum setiap hari minggu sakit dokter ibu bapak pagi malam sangat lebih lagi atau juga oleh saat",
}
FREQUENT = {k: frozenset(v.split()) for k, v in FREQUENT.items()}
#: Scripts that name a language, in the order of their trial; Japanese has kana among its Han characters.
SCRIPTS = {
    "ja": "぀-ヿｦ-ﾟ", "ko": "가-힯ᄀ-ᇿ", "ru": "Ѐ-ӿ", "el": "Ͱ-Ͽἀ-῿", "ar": "؀-ۿݐ-ݿ", "he": "֐-׿", "th": "฀-๿", "hi": "ऀ-ॿ",
}
SCRIPTS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
#: How a question asks for a language.
ASKED = {
    "en": r"in english|用英[语文]|英[语文]回答", "zh": r"in (?:chinese|mandarin)|用(?:中文|汉语|普通话)|中文回答", "es": r"in spanish|用西班牙[语文]", "de": r"in german|用德[语文]", "fr": r"in french|用法[语文]", "pt": r"in portuguese|用葡萄牙[语文]",
    "it": r"in italian|用意大利[语文]", "nl": r"in dutch|用荷兰[语文]", "pl": r"in polish|用波兰[语文]", "sv": r"in swedish|用瑞典[语文]", "tr": r"in turkish|用土耳其[语文]", "ro": r"in romanian|用罗马尼亚[语文]", "vi": r"in vietnamese|用越南[语文]",
    "id": r"in indonesian|用印尼[语文]", "ja": r"in japanese|用日[语文]", "ko": r"in korean|用韩[语文]", "ru": r"in russian|用俄[语文]", "el": r"in greek|用希腊[语文]", "ar": r"in arabic|用阿拉伯[语文]", "he": r"in hebrew|用希伯来[语文]", "th": r"in thai|用泰[语文]", "hi": r"in hindi|用印地[语文]",
}
ASKED = {k: re.compile(v, re.I) for k, v in ASKED.items()}
HAN_CHAR = re.compile("[〇㐀-䶿一-鿿豈-﫿]")
LATIN_WORD = re.compile(r"[^\W\d_Ͱ-῿぀-￿]+")
MARGIN = 0.25


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + k] for k in (1, 2, 3, 4) for i in range(len(w) - k + 1)]


def trained() -> dict[str, dict[str, float]]:
    """Log of the smoothed share of each n-gram among the frequent words of each language, and under "" that of an unseen one."""
    models = {}
    for lang, words in FREQUENT.items():
        count: dict[str, int] = {}
        for w in words:
            for g in grams(w):
                count[g] = count.get(g, 0) + 1
        total = sum(count.values())
        models[lang] = {g: math.log((k + 0.5) / (total + 2000)) for g, k in count.items()} | {"": math.log(0.5 / (total + 2000))}
    return models


MODELS = trained()
LETTERS = {k: frozenset("".join(v)) for k, v in FREQUENT.items()}


def latin(words: list[str], own: str | None, ended: bool) -> str | None:
    """The language of Latin-script words: another than ``own`` only if it surely is; without own, or if that is of another script, the likeliest."""
    hits = {k: sum(w in v for w in words) for k, v in FREQUENT.items()}
    most = max(hits.values())
    if hits.get(own, -1) > 0 and hits[own] >= most:
        return own
    odd = sum(any(c > "\x7f" and c in LETTERS[k] and c not in LETTERS.get(own, ()) for c in w) for w in words for k in (max(hits, key=lambda k: hits[k]),))
    if own in MODELS and most + odd < 2 or not most and not odd:
        return None
    flat = [g for w in words for g in grams(w)]
    score = {k: sum(m.get(g, m[""]) for g in flat) / len(flat) + 2.0 * hits[k] / len(words) for k, m in MODELS.items()}
    best = max(score, key=lambda k: (score[k], k))
    if own not in MODELS:
        return best if hits[best] >= 2 or hits[best] and len(words) >= 6 and ended else None
    return best if hits[best] + odd - hits[own] >= 2 and score[best] > score[own] + MARGIN else None


def language(text: str, own: str | None = None) -> str | None:
    """Language of a text with a sentence in it; None for names, values and units. ``own``: the language it should have."""
    han = len(HAN_CHAR.findall(text))
    words = [w.lower() for w in LATIN_WORD.findall(text)]
    for lang, script in SCRIPTS.items():
        n = len(script.findall(text))
        if n >= 6 and n * (4 if lang == "ja" else 1) >= han and n >= 2 * len(words):
            return lang
    if han >= 5 and han >= 2 * len(words):
        return "zh" if han >= 9 or text.rstrip()[-1:] in "。！？!?." else None
    return latin(words, own, text.rstrip()[-1:] in ".!?") if len(words) >= 4 else None


def own_language(question: str) -> str | None:
    """Language of a question, which may be long and name many persons."""
    words = LATIN_WORD.findall(question)
    for lang, script in SCRIPTS.items():
        if len(script.findall(question)) * (4 if lang == "ja" else 1) > max(5, len(HAN_CHAR.findall(question)), 2 * len(words)):
            return lang
    if len(HAN_CHAR.findall(question)) > len(words):
        return "zh"
    hits = {k: sum(w.lower() in v for w in words) for k, v in FREQUENT.items()}
    best = max(hits, key=lambda k: (hits[k], k))
    return best if hits[best] >= 2 else None


def is_foreign(answer: str, question: str, asked: str | None) -> bool:
    """``asked``: the question's own language."""
    if asked is None:
        return False
    spoken = language(answer, asked)
    return spoken is not None and spoken != asked and not ASKED[spoken].search(question)
