"""The script expected of each language, languages and routes."""

#: language: script, class of its characters, least share of letters.
SCRIPTS = {
    "hi": ("Devanagari", r"[ऀ-ॿ]", 0.3),
    "bn": ("Bengali", r"[ঀ-৿]", 0.3),
    "te": ("Telugu", r"[ఀ-౿]", 0.3),
    "ta": ("Tamil", r"[஀-௿]", 0.3),
    "mr": ("Devanagari", r"[ऀ-ॿ]", 0.3),
    "gu": ("Gujarati", r"[઀-૿]", 0.3),
    "kn": ("Kannada", r"[ಀ-೿]", 0.3),
    "ml": ("Malayalam", r"[ഀ-ൿ]", 0.3),
    "pa": ("Gurmukhi", r"[਀-੿]", 0.3),
    "ur": ("Arabic", r"[؀-ۿ]", 0.3),
    "ar": ("Arabic", r"[؀-ۿ]", 0.3),
    "zh": ("CJK", r"[一-鿿]", 0.3),
    "ja": ("CJK", r"[一-鿿぀-ゟ゠-ヿ]", 0.3),
    "ko": ("Hangul", r"[가-힯]", 0.3),
    "en": ("Latin", r"[a-zA-Z]", 0.5),
    "es": ("Latin", r"[a-zA-ZáéíóúüñÁÉÍÓÚÜÑ]", 0.5),
    "fr": ("Latin", r"[a-zA-ZàâäæçéèêëïîôöœùûüÿÁÂÄÆÇÉÈÊËÏÎÔÖŒÙÛÜŸ]", 0.5),
    "de": ("Latin", r"[a-zA-ZäöüßÄÖÜ]", 0.5),
    "ru": ("Cyrillic", r"[Ѐ-ӿ]", 0.4),
}

#: Blocks whose characters are not garbage, beside words, white space and plain punctuation.
BLOCKS = r"ऀ-ॿঀ-৿਀-੿઀-૿଀-୿஀-௿ఀ-౿ಀ-೿ഀ-ൿ؀-ۿЀ-ӿ一-鿿぀-ゟ゠-ヿ가-힯"
#: The narrower list of the transcript gate.
GATE_BLOCKS = r"ऀ-ॿ઀-૿஀-௿ಀ-೿ഀ-ൿ"

#: language: code of the multilingual translation models.
MODEL_CODES = {
    "en": "eng_Latn", "hi": "hin_Deva", "bn": "ben_Beng", "te": "tel_Telu", "ta": "tam_Taml", "mr": "mar_Deva", "gu": "guj_Gujr",
    "kn": "kan_Knda", "ml": "mal_Mlym", "pa": "pan_Guru", "or": "ory_Orya", "as": "asm_Beng", "ur": "urd_Arab", "fr": "fra_Latn",
    "de": "deu_Latn", "es": "spa_Latn", "zh": "zho_Hans", "ar": "arb_Arab", "ru": "rus_Cyrl", "ja": "jpn_Jpan", "ko": "kor_Hang",
}
#: Languages that the synthesizer knows by name.
SPEECH_NAMES = {"en": "english", "zh": "chinese", "ja": "japanese", "ko": "korean", "de": "german", "fr": "french", "ru": "russian", "pt": "portuguese", "es": "spanish", "it": "italian", "mr": "auto"}
#: Languages paired with English by backend: from English, and to it.
INDIC_FROM_ENGLISH = ["hi", "bn", "te", "ta", "mr", "gu", "kn", "ml", "pa", "ur"]
INDIC_TO_ENGLISH = ["hi", "bn", "te", "ta", "mr", "gu", "kn", "ml", "pa"]
EUROPEAN = ["es", "fr", "de"]
ROUTES = [("en", x, "indictrans2") for x in INDIC_FROM_ENGLISH] + [(x, "en", "indictrans2") for x in INDIC_TO_ENGLISH] + [("en", x, "marian") for x in EUROPEAN] + [(x, "en", "marian") for x in EUROPEAN]
BACKENDS = ["indictrans2", "marian", "nllb", "google"]

#: tier: prefers the CPU for long and for very long videos; chunk seconds of short, medium, long and very long videos; batch size.
TIERS = {
    "cpu": (True, True, (45.0, 90.0, 120.0, 180.0), 1),
    "low": (True, True, (45.0, 75.0, 90.0, 120.0), 1),
    "mid": (False, True, (60.0, 120.0, 150.0, 210.0), 2),
    "high": (False, False, (60.0, 150.0, 240.0, 360.0), 3),
}
CATEGORIES = ["short", "medium", "long", "very_long"]
