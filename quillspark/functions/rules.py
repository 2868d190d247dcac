"""Rule registers: data that the operators run on.

The lists below are fixed values: results depend on them, so they are stated plainly, in
their order of precedence. Patterns are Java regular expressions; ``search`` sets the
flags under which white space is Unicode's and ^ and $ match at line ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character classes of Devanagari -------------------------
CONSONANTS = "क-ह\u0958-\u095fॸ-ॿ"
NUKTA, VIRAMA, I_MATRA = "\u093c", "\u094d", "\u093f"
MATRAS = "\u093a\u093b\u093e-\u094c\u094e\u094f\u0955-\u0957\u0962\u0963"
SIGNS = "\u0900-\u0903"
VOWELS = "\u0904-\u0914\u0960\u0961\u0972-\u0977"
REPH, REPH_MARK = "र्", "\ue000"
DIGIT = "[0-9०-९]"
BLANK_RUN = "[-–—_.░]{3,}"
DEVA_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"
MONTH_NUMBERS = {
    "जनवरी": 1, "फरवरी": 2, "मार्च": 3, "अप्रैल": 4, "मई": 5, "जून": 6, "जुलाई": 7, "अगस्त": 8, "सितम्बर": 9, "सितंबर": 9,
    "अक्टूबर": 10, "नवम्बर": 11, "नवंबर": 11, "दिसम्बर": 12, "दिसंबर": 12,
}

# --- fixed values: anchors (name, role, weight, alternatives) --------------
_SEP = r"[\-/.–—]"
_DATE = rf"{DIGIT}{{1,2}}\s*{_SEP}\s*{DIGIT}{{1,2}}\s*{_SEP}\s*{DIGIT}{{2,4}}"
_MONTHS = "(?:" + "|".join(MONTH_NUMBERS) + ")"
ANCHORS: list[tuple[str, str, float, list[str]]] = [
    ("letter_number", "start", 0.20, [
        r"पत्र\s*(?:क्रमांक|संख्या|सं0?\.?|सङ्ख्या)", r"पत्रांक", r"क्रमांक\s*[:\-ः]", r"(?:आदेश|ज्ञापन|अधिसूचना|परिपत्र)\s*(?:क्रमांक|संख्या|सं0?\.?)",
        r"ज्ञापांक", r"पृष्ठांकित\s*पत्रांक", r"\bफा\s*\.?\s*सं\s*\.?", r"\bF\s*\.?\s*No\s*\.?", r"\bNo\s*\.\s*(?=[A-Za-z0-9])", r"\bसं\s*\.\s*(?=[0-9०-९])",
    ]),
    ("header", "start", 0.0, [
        r"भारत\s*सरकार", r"राज्य\s*सरकार", r"शासन\s*[,\s]", r"कार्यालय\s*[,\-–]?\s*\S", r"मुख्य\s*कार्यालय", r"(?:महा)?निदेशालय", r"मंत्रालय", r"सचिवालय",
        r"(?:जिला|संभाग|मंडल|नगर)\s*(?:कार्यालय|पंचायत|निगम|परिषद)", r"आयुक्त\s*कार्यालय", r"कलेक्टर\s*कार्यालय", r"\bOffice\s+of\s+the\b", r"\bGovernment\s+of\b",
    ]),
    ("date", "content", 0.15, [
        rf"दिनांक\s*[:\-ः]?\s*{DIGIT}", rf"दि\s*\.\s*{DIGIT}", r"दिनांक\s*[:\-ः]?\s*[-–—_.]{3,}", r"(?:दिनंाक|दिनाक)\s*[:\-ः]?",
        rf"{DIGIT}{{1,2}}\s+{_MONTHS}\s+{DIGIT}{{2,4}}", rf"(?<![0-9०-९\-/.–—]){_DATE}(?![0-9०-९])", r"\bDated?\s*[:\-]?\s*",
    ]),
    ("addressee", "content", 0.15, [r"^\s*सेवा\s*में\s*[,ः:]?\s*$", r"^\s*सेवा\s*में\s*[,ः:]", r"^\s*प्रति\s*[,ः:]?\s*$", r"^\s*प्रति\s*[,ः:]", r"^\s*प्रेषिती\s*[,ः:]?", r"^\s*To\s*[,:]?\s*$"]),
    ("subject", "content", 0.20, [r"विषय\s*[:\-ः–]", r"^\s*विषय\s+", r"\bSub(?:ject)?\s*[:\-]"]),
    ("reference", "content", 0.0, [
        r"प्रसंग\s*[:\-ः–]", r"प्रसङ्ग\s*[:\-ः–]", r"विषयक\s*[:ः]", r"संदर्भ\s*[:\-ः–]", r"सन्दर्भ\s*[:\-ः–]",
        r"कृपया\s+(?:उपरोक्त\s+)?संदर्भ", r"\bRef(?:erence)?\s*[:\-]", r"आपके\s+पत्र\s+(?:क्रमांक|संख्या)",
    ]),
    ("salutation", "content", 0.0, [
        r"^\s*महाशय(?:ा)?\s*[,ः:]?\s*$", r"^\s*महाशय(?:ा)?\s*[,ः:]", r"^\s*महोदय(?:ा)?\s*[,ः:]?\s*$", r"^\s*महोदय(?:ा)?\s*[,ः:]", r"^\s*महाभाग\s*[,ः:]?",
        r"^\s*प्रिय\s+मह(?:ोदय|ाशय)(?:ा)?", r"^\s*माननीय\s+मह(?:ोदय|ाशय)", r"^\s*Sir\s*[,:]", r"^\s*Madam\s*[,:]",
    ]),
    ("closing", "end", 0.15, [
        r"विश्वासभाजन", r"विश्वासपात्र", r"हस्ताक्षर(?:ित)?", r"अनु\s*[०0]", r"भवदीय(?:ा)?", r"सादर", r"शुभकामनाओं\s+सहित",
        r"\(\s*हस्ता(?:।|\.|़)?\s*\)", r"ह\s*/\s*-", r"\bYours\s+(?:faithfully|sincerely|truly)\b",
    ]),
    ("distribution", "end", 0.0, [r"प्रतिलिपि\s*[:\-ः–]", r"प्रतिलिपि\s+(?:सूचनार्थ|प्रेषित)", r"पृष्ठांकन\s*(?:क्रमांक|संख्या)?", r"पृष्ठांकित", r"\bCopy\s+(?:to|forwarded)\b", r"संलग्न\s*[:\-ः–]"]),
    ("noise", "noise", 0.0, [
        rf"^\s*[\-–(]?\s*{DIGIT}{{1,3}}\s*[\-–)]?\s*$", rf"^\s*पृष्ठ\s*[:\-]?\s*{DIGIT}", rf"^\s*Page\s+{DIGIT}", rf"^\s*{DIGIT}{{1,3}}\s*/\s*{DIGIT}{{1,3}}\s*$",
        r"^\s*क्रमशः\s*[.।]*\s*$", r"^\s*जारी\s*[.।]*\s*$", r"^\s*\.{3,}\s*$", r"^\s*[-–_=*]{3,}\s*$",
    ]),
]
ROLE_ORDER = {"header": 0, "letter_number": 1, "date": 2, "addressee": 3, "subject": 5, "reference": 6, "salutation": 7, "closing": 9, "distribution": 10}
UNANCHORED_ROLE = 4
#: Completeness weights of each form; the body's length adds BODY_WEIGHT.
LETTER_WEIGHTS = {"letter_number": 0.20, "date": 0.15, "addressee": 0.15, "subject": 0.20, "closing": 0.15}
FORM_WEIGHTS = {
    "letter": LETTER_WEIGHTS,
    "order": {"letter_number": 0.30, "date": 0.25, "header": 0.15, "distribution": 0.15},
    "endorsement": {"letter_number": 0.40, "date": 0.25, "distribution": 0.20},
    "fragment": LETTER_WEIGHTS,
}
BODY_WEIGHT, BODY_TARGET, MIN_SEGMENT, MAX_ENDORSEMENT = 0.15, 300, 120, 600
ADDRESSEE_LINE = r"^\s*(?:सेवा\s*में|प्रति|प्रेषिती|To)\s*[,ः:]?\s*$"
ORDER_MARKER = r"^\s*(?:कार्यालय\s*)?(?:आदेश|ज्ञापन|अधिसूचना|परिपत्र|संकल्प|पृष्ठांकन|अनुदेश)\s*[।:\-–]?\s*$"
SOURCE_TIERS = {"unicode": 1.0, "docx": 0.85, "pdf": 0.6, "ocr": 0.4}

# --- fixed values: validator rules (name, weight, pattern) -----------------
VIRAMA_FINAL_WORDS = "एतद तहत विधिवत सम्यक महत जगत विद्युत भवत श्रीमत किञ्चित पश्चात कदाचित बृहत परिषद आयुष्मत विद्वत सक्षमत श्रीमान".split()
_LATIN, _WELD = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", r"[\u0900-\u0965\u0970-\u097f\ua8e0-\ua8ff]"
VALIDATOR: list[tuple[str, float, str]] = [
    ("matra_word_initial", 3.0, rf"(?:^|(?<=[\s\n(\[]))(?:[{MATRAS}]|{VIRAMA}|{NUKTA})"),
    ("double_matra", 3.0, rf"[{MATRAS}][{MATRAS}]"),
    ("virama_then_matra", 3.0, rf"{VIRAMA}[{MATRAS}]"),
    ("matra_after_vowel", 2.5, rf"[{VOWELS}][{MATRAS}]"),
    ("vowel_after_virama", 2.5, rf"{VIRAMA}[{VOWELS}]"),
    ("nukta_misplaced", 2.0, rf"(?<![{CONSONANTS}]){NUKTA}"),
    ("sign_word_initial", 2.0, rf"(?:^|(?<=[\s\n]))[{SIGNS}]"),
    ("virama_word_final", 0.5, "".join(f"(?<!{w})" for w in VIRAMA_FINAL_WORDS) + rf"{VIRAMA}(?=[\s\n.,।॥)\]]|\z)"),
    ("latin_inside_word", 3.0, rf"(?:{_LATIN}(?={_WELD})|{_WELD}(?={_LATIN}))"),
    ("pua_leak", 5.0, r"[\ue000-\uf8ff]"),
    ("replacement_char", 5.0, r"\ufffd"),
]
MIN_VOCABULARY = 500

# --- fixed values: labels ---------------------------------------------------
BRANCHES = {
    "रा": "राजस्व", "रा०": "राजस्व", "राज": "राजस्व", "स्था": "स्थापना", "स्था०": "स्थापना", "वि": "विकास", "वि०": "विकास", "विधि": "विधि",
    "म०नि०": "मनरेगा", "प०पा०": "पंचायती राज", "निर्वाचन": "निर्वाचन", "सी": "सामान्य", "सी०": "सामान्य", "शि": "शिक्षा", "शि०": "शिक्षा", "स्वा": "स्वास्थ्य",
}
OFFICES = [
    (r"राजस्व", "राजस्व"), (r"स्थापना", "स्थापना"), (r"प्रखण्ड\s*विकास|प्रखंड\s*विकास|विकास\s*पदाधिकारी", "विकास"), (r"बैंकिंग|कोषांग", "बैंकिंग"), (r"शिक्षा", "शिक्षा"),
    (r"स्वास्थ्य", "स्वास्थ्य"), (r"पंचायत", "पंचायती राज"), (r"निर्वाचन", "निर्वाचन"), (r"आपूर्ति", "आपूर्ति"), (r"नगर\s*निगम|नगर\s*परिषद", "नगर निकाय"),
]
LETTER_TYPES = [
    (r"कारण\s*बताओ|शोकॉज|शो\s*कॉज|स्पष्टीकरण", "स्पष्टीकरण"), (r"अनुशासनिक|विभागीय\s*कार्यवाही|आरोप\s*पत्र|निलंब", "अनुशासनिक"),
    (r"अग्रसारित|अग्रेषित|अग्रसरित|forward", "अग्रसारण"), (r"समीक्षा\s*बैठक|बैठक\s*(?:की|हेतु|का)|बैठक", "बैठक सूचना"),
    (r"स्थानान्तरण|स्थानांतरण|पदस्थापन|तबादला", "स्थानांतरण"), (r"सेवानिवृ|पेंशन|पेन्शन|उपादान", "सेवानिवृत्ति"), (r"वेतन|भुगतान|देयक|राशि\s*की\s*निकासी", "भुगतान"),
    (r"जाँच|जांच|अन्वेषण|सत्यापन", "जाँच"), (r"प्रतिवेदन|प्रगति\s*प्रतिवेदन|रिपोर्ट", "प्रतिवेदन"), (r"आवंटन|आबंटन", "आवंटन"), (r"निविदा|टेंडर", "निविदा"),
    (r"नियुक्ति|संविदा\s*नियुक्ति", "नियुक्ति"), (r"अनुमति|स्वीकृति", "अनुमति"),
    (r"बनाम|न्यायालय|(?<![ऀ-ॿ])वाद\s*सं|रिट\s*याचिका|Cr\.?\s*W|\bWJC\b|अवमानना", "न्यायालय वाद"), (r"परिवाद|शिकायत|लोक\s*शिकायत", "परिवाद"),
    (r"दाखिल[\s-]*खारिज|जमाबंदी|भू[\s-]*लगान|अतिक्रमण|भूमि|खेसरा|खाता", "भूमि"), (r"योजना|अभियान|कैम्प|शिविर|Campaign", "योजना"), (r"सूचना|सूचित", "सामान्य सूचना"),
]
DEFAULT_TYPE, UNLABELLED = "सामान्य पत्राचार", "UNLABELLED"

# --- fixed values: repair ---------------------------------------------------
VISARGA = "ः"
VISARGA_WORDS = "अतः प्रायः स्वतः मुख्यतः विशेषतः सामान्यतः पूर्णतः अंशतः क्रमशः यथासंभवतः संभवतः वस्तुतः मूलतः प्रथमतः अंततः निःसंदेह दुःख पुनः शनैः प्रातः".split()
COLON_LABELS = [
    "विषय", "संदर्भ", "सन्दर्भ", "प्रतिलिपि", "संख्या", "क्रमांक", "दिनांक", "प्रेषक", "सेवा में", "प्रति", "उत्तर", "अनुलग्नक", "टिप्पणी", "कृते", "पृष्ठांकन",
    "पत्रांक", "ज्ञापांक", "प्रसंग", "प्रसङ्ग", "विषयक", "अनु०", "स्मारांक",
]

# --- fixed values: field labels ---------------------------------------------
NUMBER_LABEL = r"(?:पत्रांक|ज्ञापांक|ज्ञापंाक|स्मारांक|पत्र\s*संख्या|क्रमांक|फा\s*\.?\s*सं\s*\.?|F\s*\.?\s*No\s*\.?)"
DATE_LABEL = r"(?:दिनांक|दिनंाक|दिनाक|Dated?)"
NEXT_LABEL = r"(?:दिनांक|दिनंाक|दिनाक|Dated?\b|विषय|प्रसंग|संदर्भ|सन्दर्भ|प्रतिलिपि|सेवा\s*में|प्रेषक|मह(?:ोदय|ाशय)|Sub\b|Ref\b|Copy\s+to)"
OFFICE_WORDS = r"कार्यालय|समाहरणालय|निदेशालय|मंत्रालय|शाखा|विभाग|निगम|पंचायत|कोषांग"

#: ^ and $ at \n alone, \s of Unicode.
FLAGS = "(?Udm)"


def search(col: Column | str, pattern: str) -> Column:
    """Whether the pattern occurs in a text."""
    return (F.col(col) if isinstance(col, str) else col).rlike(FLAGS + pattern)


def anchor_pattern(name: str, extra: dict[str, list[str]] | None = None) -> str:
    """An anchor's alternatives as one pattern, with an office's own added."""
    found = {n: alts for n, _, _, alts in ANCHORS}
    unknown = set(extra or {}) - set(found)
    if unknown:
        raise ValueError(f"unknown anchors: {sorted(unknown)}")
    return "(?:" + "|".join([*found[name], *(extra or {}).get(name, [])]) + ")"


def first_label(col: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule that matches; null if none does."""
    return F.coalesce(*(F.when(search(col, p), F.lit(v)) for p, v in rules))
