"""Word lists. The spelling of each entry, nukta letters in two
characters, is part of the behaviour (see ``lexicon``)."""

from __future__ import annotations

import unicodedata

# Fixed values.
NEGATIONS = [
    "না", "নাই", "নেই", "নয়", "না-ই", "নয়তো", "নয়তঃ", "নহে", "নাহ", "নাহ্", "নাইরে", "কখনো না", "কখনও না",
    "কখনই না", "কোনো না", "কোনোভাবেই না", "মোটেই না", "মোটেও না", "একেবারে না", "অবশ্যই না", "আর না", "আর নয়",
    "কিছুতেই না", "কিছুতেই নয়", "একদমই না", "না তো", "না রে", "নয়কো", "ছাড়া", "বিনা", "ব্যতীত",
]

# Fixed values.
INTENSIFIERS = [
    "খুব", "অনেক", "একদম", "অত্যন্ত", "অত্যধিক", "অসাধারণ", "অবিশ্বাস্য", "অতি", "সত্যিই", "সত্যি", "আসলেই", "আসলে",
    "সত্যিকার", "একেবারে", "মোটেই", "মোটেও", "বেশি", "বেশ", "বেশি বেশি", "খুবই", "খুবি", "ভীষণ", "ভীষণ ভাবে",
    "ভীষণভাবে", "অনেক বেশি", "বহুত", "বহুত বেশি", "পুরোপুরি", "সম্পূর্ণ", "সম্পূর্ণভাবে", "হাজার", "লক্ষ", "কোটি",
    "অত্যন্তই", "অনেকটা", "মারাত্মক", "মারাত্মক ভাবে", "মারাত্মকভাবে", "জঘন্য", "চরম", "প্রচুর", "দারুণভাবে", "বিশাল",
    "ভয়ানকভাবে", "মারাত্বক",
]

# Fixed values.
POSITIVE = [
    "ভালো", "ভালোবাসা", "ভালোবাসি", "ভালোলাগা", "সুন্দর", "আনন্দ", "খুশি", "সুখ", "সুখী", "মজা", "মজার", "দারুণ",
    "অসাধারণ", "চমৎকার", "শান্তি", "শান্তিপূর্ণ", "হাসি", "হাসিখুশি", "প্রেম", "প্রিয়", "আদর", "স্নেহ", "ধন্যবাদ",
    "কৃতজ্ঞ", "কৃতজ্ঞতা", "অভিনন্দন", "শুভ", "উৎসাহ", "উৎসাহী", "সফল", "সাফল্য", "বিজয়", "জয়", "গর্ব", "গর্বিত",
    "উপভোগ", "মনোরম", "আশা", "স্বপ্ন", "প্রেরণা", "অনুপ্রেরণা", "স্বাগত", "মিষ্টি", "সহানুভূতি", "সহমর্মিতা", "ভক্তি",
    "শ্রদ্ধা", "বিস্ময়কর", "অবাক", "আশ্চর্য", "আশ্চর্যজনক", "উত্তেজনা", "উত্তেজিত", "উল্লাস", "উল্লসিত", "প্রশংসা",
    "প্রশংসনীয়", "অপূর্ব", "নিখুঁত", "নিরাপদ", "আরামদায়ক", "সুরক্ষিত", "বিনোদন", "পছন্দ", "পছন্দনীয়", "উপকারী",
    "উপকার", "সহায়তা", "সাহায্য", "আশীর্বাদ", "শুভকামনা", "শুভেচ্ছা", "তৃপ্তি", "সন্তোষ", "সন্তুষ্ট", "উজ্জ্বল",
    "পরিষ্কার", "সত্যিই ভালো",
]

# Fixed values.
NEGATIVE = [
    "খারাপ", "ঘৃণা", "ঘৃণ্য", "রাগ", "রাগান্বিত", "ক্ষোভ", "ক্রোধ", "দুঃখ", "দুঃখিত", "কষ্ট", "যন্ত্রণা", "ব্যথা",
    "ভয়", "ভীতি", "আতঙ্ক", "ভয়ঙ্কর", "ভয়াবহ", "বিরক্ত", "বিরক্তি", "বিরক্তিকর", "অসুখী", "দুর্ভোগ", "হতাশা",
    "হতাশ", "নিরাশা", "নিরাশ", "বিষণ্নতা", "বিষণ্ণ", "অবমাননা", "অপমান", "লজ্জা", "লজ্জিত", "ব্যর্থ", "ব্যর্থতা",
    "পরাজয়", "পরাজিত", "মৃত্যু", "শোক", "কান্না", "কাঁদা", "অশ্রু", "চিৎকার", "অভিযোগ", "ঝগড়া", "ঝামেলা", "সমস্যা",
    "বিপদ", "বিপজ্জনক", "ভয়ের", "আতঙ্কিত", "উদ্বেগ", "উদ্বিগ্ন", "ক্লান্ত", "ক্লান্তি", "বিরক্তকর", "অপছন্দ",
    "ঘৃণিত", "জঘন্য", "নোংরা", "নষ্ট", "বিশ্বাসঘাতক", "বিশ্বাসঘাতকতা", "প্রতারণা", "প্রতারক", "মিথ্যা", "মিথ্যুক",
    "অন্যায়", "অত্যাচার", "নির্যাতন", "নিষ্ঠুর", "নিষ্ঠুরতা", "কুৎসিত", "ক্ষতি", "ক্ষতিকর", "অসুস্থ", "রোগ", "বেদনা",
    "দুর্দশা", "অসহায়", "একাকী", "একাকীত্ব", "মন খারাপ", "মনোকষ্ট", "বিপর্যয়", "দুর্ঘটনা", "মারামারি", "হত্যা",
    "অপরাধ",
]

# Fixed values.
EMOTIONS = {
    "anger": [
    "রাগ", "রাগান্বিত", "ক্রোধ", "ক্ষোভ", "চিৎকার", "ঝগড়া", "অত্যাচার", "মারামারি", "খুন", "জ্বালাময়ী", "প্রতিশোধ",
    "উত্তেজিত", "বিরক্তিকর", "বিরক্ত", "গালি", "অপমান", "উত্তেজনা",
    ],
    "disgust": [
    "ঘৃণা", "ঘৃণ্য", "জঘন্য", "নোংরা", "কুৎসিত", "অপছন্দ", "বিরক্তি", "বমি", "নষ্ট", "ঘৃণিত", "ধিক্কার", "ঘেন্না",
    "ছি", "ছিঃ", "অখাদ্য", "বাজে", "পচা", "নিকৃষ্ট",
    ],
    "fear": [
    "ভয়", "ভীতি", "আতঙ্ক", "ভয়ঙ্কর", "ভয়াবহ", "বিপদ", "বিপজ্জনক", "আতঙ্কিত", "উদ্বেগ", "উদ্বিগ্ন", "অনিশ্চয়তা",
    "ত্রাস", "শঙ্কা", "ভীত", "আতঙ্কগ্রস্ত", "অসহায়",
    ],
    "joy": [
    "আনন্দ", "খুশি", "সুখ", "সুখী", "মজা", "দারুণ", "অসাধারণ", "চমৎকার", "শান্তি", "হাসি", "হাসিখুশি", "ধন্যবাদ",
    "অভিনন্দন", "শুভ", "সফল", "সাফল্য", "বিজয়", "গর্ব", "উপভোগ", "মিষ্টি", "উল্লাস", "প্রশংসা", "অপূর্ব", "নিখুঁত",
    "সেরা", "সুন্দর", "ভালোবাসা", "ভালোবাসি",
    ],
    "sadness": [
    "দুঃখ", "দুঃখিত", "কষ্ট", "যন্ত্রণা", "ব্যথা", "অসুখী", "দুর্ভোগ", "হতাশা", "হতাশ", "নিরাশ", "বিষণ্ণতা", "বিষণ্ণ",
    "লজ্জা", "ব্যর্থতা", "মৃত্যু", "শোক", "কান্না", "অশ্রু", "বেদনা", "দুর্দশা", "একাকী", "মন খারাপ", "বিপর্যয়",
    "হাহাকার",
    ],
    "surprise": [
    "অবাক", "আশ্চর্য", "আশ্চর্যজনক", "বিস্ময়", "বিস্ময়কর", "অপ্রত্যাশিত", "অবিশ্বাস্য", "তাজ্জব", "চমকে", "হতবাক",
    "স্তব্ধ", "অদ্ভুত", "অবিশ্বাস্যভাবে",
    ],
}

# Fixed values.
DIMINISHERS = [
    "সামান্য", "একটু", "একটু একটু", "কিছুটা", "খানিকটা", "হয়তো", "সম্ভবত", "মনে হয়", "মনে হচ্ছে", "কিছুটা কম",
    "অল্প", "অল্পস্বল্প", "নাহয়", "মাঝে মাঝে", "কখনো কখনো", "কখনও কখনও",
]

# Fixed values.
VERBS = [
    "করা", "করি", "করে", "করলে", "করব", "করছে", "হওয়া", "হয়", "হচ্ছে", "হলে", "হবে", "হয়েছে", "যাওয়া", "যায়",
    "যাব", "গেছে", "যাচ্ছে", "আসা", "আসে", "আসব", "এসেছে", "আসছে",
]

# Fixed values.
QUESTION_WORDS = [
    "কেন", "কী", "কি", "কীভাবে", "কেমন", "কখন", "কোথায়", "কোথা", "কার", "কাকে", "কতটা", "কত", "সত্যি", "সত্যিই",
    "কোনো", "আসলে",
]

# Fixed values.
CONNECTIVES = [
    "কিন্তু", "তবে", "যদিও", "তবুও", "বরং", "অথচ", "বরঞ্চ", "পরন্তু", "তথাপি", "এরপরও", "তারপরও", "সত্ত্বেও",
    "সত্ত্বে",
]

# Fixed values.
PAST, PRESENT, FUTURE = ["লাম", "ছিল", "লেন"], ["ছে", "ছেন", "ছি"], ["ব", "বে", "বেন"]


def lexicon(words: list[str], form: str = "raw") -> list[str]:
    """A list as it is spelled (``raw``), or with one-character nukta letters
    (``normalized``), as cleaned text has them; entries once each, in order."""
    if form == "normalized":
        words = [precomposed(w) for w in words]
    elif form != "raw":
        raise ValueError(f"unknown form {form!r}")
    return list(dict.fromkeys(words))


#: Two-character letters and vowel signs and their one-character forms.
COMPOSED = (
    ("\u09a1\u09bc", "\u09dc"), ("\u09a2\u09bc", "\u09dd"), ("\u09af\u09bc", "\u09df"),
    ("\u09c7\u09be", "\u09cb"), ("\u09c7\u09d7", "\u09cc"),
)


def precomposed(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    for two, one in COMPOSED:
        text = text.replace(two, one)
    return text
