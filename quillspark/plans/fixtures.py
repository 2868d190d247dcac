"""Rows of Hindi and legacy-font text, written for this package; the expected values beside them were worked out by hand."""

from __future__ import annotations

from ..operators.fonts import FontTable

HEAD = "कार्यालय जिला पदाधिकारी, सारण"
LETTER_1 = [
    HEAD, "पत्रांक-----------/रा०, दिनांक------------", "सेवा में,", "अंचल अधिकारी,", "छपरा सदर", "विषय:- भूमि की मापी के संबंध में।", "महाशय,",
    "उपर्युक्त विषय के संबंध में कहना है कि आवेदक की भूमि की मापी कराकर प्रतिवेदन दस दिनों के भीतर इस कार्यालय को उपलब्ध कराया जाय ताकि आगे की कार्रवाई की जा सके।",
    "विश्वासभाजन", "जिला पदाधिकारी",
]
LETTER_2 = [
    HEAD, "पत्रांक 45/स्था०, दिनांक 05.03.2021", "सेवा में,", "सभी प्रखंड कर्मी", "विषय:- वेतन भुगतान के संबंध में।", "महाशय,",
    "निदेशानुसार सूचित करना है कि माह फरवरी का वेतन विपत्र तीन दिनों के भीतर समर्पित किया जाय अन्यथा इसके लिए आप स्वयं जिम्मेवार होंगे।", "विश्वासभाजन", "स्थापना उप समाहर्त्ता",
]
ENDORSEMENT = ["ज्ञापांक 46/स्था०, दिनांक 05.03.2021", "प्रतिलिपि:- कोषागार पदाधिकारी को सूचनार्थ प्रेषित।"]
ORDER = ["आदेश", "आदेश संख्या 12, दिनांक 01.02.2020"] + ["कार्य हित में निम्नलिखित कर्मियों को तत्काल प्रभाव से प्रतिनियुक्त किया जाता है।"] * 4
#: (doc_id, text): two letters and an endorsement with page furniture; an order; a runt; blank lines; two letters without a
#: closing between them, of which the second begins at the line above its letterhead, as that names an office too; a line too
#: short to be a letter before one, and one after one, which both belong to it.
DOCUMENTS = [
    (1, "\n".join([*LETTER_1, "- 2 -", *LETTER_2, *ENDORSEMENT])),
    (2, "\n".join(ORDER)),
    (3, HEAD),
    (4, "\n\n"),
    (5, "\n".join([*LETTER_1[:8], *LETTER_2])),
    (6, "\n".join(["विषय:- सूचना।", *LETTER_2])),
    (7, "\n".join([*LETTER_1, "पत्रांक 99/रा०, दिनांक 01.01.2020"])),
]
#: (id, line, anchors in rule order)
TAGGED = [
    (1, "पत्रांक 45/स्था०, दिनांक 05.03.2021", "letter_number,date"), (2, "सेवा में,", "addressee"), (3, "विषय:- भूमि", "subject"), (4, "संदर्भ:- आपके पत्र क्रमांक 44", "reference"),
    (5, "- 2 -", "noise"), (6, "विश्वासभाजन", "closing"), (7, "प्रतिलिपि:- सभी को", "distribution"), (8, "महाशय,", "salutation"), (9, "साधारण वाक्य", ""), (10, "भारत सरकार", "header"), (11, "2/5", "noise"),
]
#: (id, date as written, ISO)
DATES = [
    (1, "05.03.2021", "2021-03-05"), (2, "५-३-२१", "2021-03-05"), (3, "31/12/99", "1999-12-31"), (4, "15 अगस्त 1947", "1947-08-15"), (5, "1 सितंबर २०२०", "2020-09-01"),
    (6, "32.01.2020", None), (7, "10.13.2020", None), (8, "31.02.2024", "2024-02-31"), (9, "कोई तिथि नहीं", None), (10, "1.1.1850", None), (11, "", None),
]
#: (id, text, repaired, how many)
VISARGA = [
    (1, "विषयः भूमि", "विषय: भूमि", 1), (2, "अतः यह", "अतः यह", 0), (3, "नामः राम", "नाम: राम", 1), (4, "प्रायः पुनः", "प्रायः पुनः", 0), (5, "राम ः श्याम", "राम : श्याम", 1),
    (6, "दुःख", "दुःख", 0), (7, "पत्रांकः12", "पत्रांक:12", 1), (8, "", "", 0), (9, "स्वतः।", "स्वतः।", 0),
]
#: (id, text, rules broken)
BROKEN = [
    (1, "िजला", "matra_word_initial=1"), (2, "काी", "double_matra=1"), (3, "क्ि", "virama_then_matra=1"), (4, "अा", "matra_after_vowel=1"), (5, "क्अ", "vowel_after_virama=1"), (6, "अ़", "nukta_misplaced=1"),
    (7, "ंक", "sign_word_initial=1"), (8, "क्", "virama_word_final=1"), (9, "कa", "latin_inside_word=1"), (10, "क\ue005", "pua_leak=1"), (11, "क\ufffd", "replacement_char=1"), (12, "जिला पदाधिकारी", ""), (13, "plain", ""), (14, "तहत् यह", ""), (15, "पुट् ाक ाी", "double_matra=1,matra_word_initial=2,virama_word_final=1"),
]
#: (id, text, score x 10000): .65 of the sequence score and .35 of the script's share
SCORED = [(1, "जिला पदाधिकारी", 10000), (2, "काी", 3500), (3, "plain text", 0), (4, "", 0), (5, "क् ख ग घ", 9188), (6, "कख गघ चछ abc", 8833)]
#: (id, text, cleaned, labels)
CLEANED = [
    (1, "```\nयह पाठ\n```", "यह पाठ", "code fence (2)"), (2, "# शीर्ष\nपाठ", "शीर्ष\nपाठ", "markdown heading (1)"), (3, "* एक\n* दो", "एक\nदो", "markdown bullet (2)"), (4, "**मोटा** पाठ", "मोटा पाठ", "markdown bold"),
    (5, "पाठ\n[आपका नाम]", "पाठ", "placeholder line the model invented (1)"), (6, "श्री [नाम] को", "श्री  को", "inline placeholder"), (7, "पत्रांक 12\nपाठ", "पाठ", "invented letter-number line (1)"),
    (8, "दिनांक 1.1.20\nपाठ", "पाठ", "invented date line (1)"), (9, "विषय: क\nपाठ", "पाठ", "duplicate subject line (1)"), (10, "महोदय,\nपाठ\nभवदीय,", "पाठ", "salutation the skeleton supplies (1);closing block the skeleton supplies (1)"), (11, "साफ पाठ", "साफ पाठ", ""),
]
#: A small legacy table of our own; Z is the reph mark.
TOY = FontTable("toy", {"d": "क", "[k": "ख", "x": "ग", "f": "ि", "k": "ा", "h": "ी", "Z": "\ue000", "D": "क्", "e": "म", "1": "१", ".k": "ण"})
#: (legacy, expected): substitution, longest match, both reorder passes
PAIRS = [
    ("d", "क"), ("[k", "ख"), ("dk", "का"), ("fd", "कि"), ("fDx", "क्गि"), ("dZ", "र्क"), ("dkZ", "र्का"), ("fdZ", "र्कि"), ("x.k", "गण"), ("d e", "क म"), ("d1", "क१"), ("Zd", "र्क"),
]
#: (id, text, misfonted Latin runs)
LATIN = [(1, "संख्या CWJC-12 देखें", "CWJC-12"), (2, "ABC", ""), (3, "A1", ""), (4, "AB/1 और X-Y2", "AB/1,X-Y2"), (5, "12345", ""), (6, "", "")]
#: (id, chars, pages, quality, forced, route)
PDFS = [(1, 5000, 2, 0.95, False, "text-layer"), (2, 100, 1, 0.95, False, "ocr"), (3, 5000, 2, 0.5, False, "ocr"), (4, 5000, 2, 0.95, True, "ocr"), (5, 119, 0, 0.9, False, "ocr"), (6, 240, 2, 0.8, False, "text-layer")]
#: (id, conf, tier)
READINGS = [(1, 100.0, "ocr"), (2, 60.0, "ocr"), (3, 80.0, "ocr"), (4, 10.0, "ocr"), (5, 10.0, "docx")]
#: (id, verdict, blind, suggestion, outcome)
REVIEWS = [(1, "ok", False, "क", "agreed"), (2, "OK", True, "क", "rejected"), (3, "", False, "क", "blank"), (4, "ख", True, "क", "corrected"), (5, "क", True, "क", "agreed"), (6, "ग", False, "क", "corrected"), (7, "सही", False, "क", "agreed"), (8, None, True, "क", "blank"), (9, "घ", True, "क", "corrected")]
#: (id, reading, other reading)
READ_TWICE = [(1, "राम घर गया", "राम धर गया"), (2, "वह घर है", "वह धर है"), (3, "घर बड़ा", "धर बड़ा"), (4, "एक दो तीन", "एक तीन"), (5, "सब ठीक", "सब ठीक"), (6, "घर", "घर आया")]
#: (legacy, used keys)
PICKS = [("aaaa", ["1", "2"]), ("bb", ["2", "3", "4"]), ("c", ["1"]), ("ddd", ["2", "3", "4"]), ("e", ["4"]), ("f", [])]
#: (id, font, text) in order, two blocks
RUNS = [(1, [[("अ", None), ("ब", None), ("d", "Kruti Dev 010"), ("k", "kruti dev  010"), ("e", "Arial")], [("x", "DevLys 010"), ("fd", "Devlys 010 Bold")]])]
#: (id, invented, truncated, verdict, sources, letters, review)
DRAFTS = [(1, [], False, "clean", 3, 100, False), (2, ["12"], False, "clean", 3, 100, True), (3, [], True, "clean", 3, 100, True), (4, [], False, "review", 3, 100, True), (5, [], False, "clean", 0, 100, True), (6, [], False, "clean", 3, 29, True)]
