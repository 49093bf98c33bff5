"""Word lists, patterns and constants that results depend on.

All are given as data; operators build their expressions from them.
Word characters are written out, so that Java's and RE2's engines agree.
"""

from __future__ import annotations

# White space as Python's str.split() sees it; a word by letters, digits and underscores.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = r"[^\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"[\p{L}\p{N}_]"

WORD_ASCII = r"[A-Za-z']+"
WORD_UNICODE = rf"{W}+(?:'+{W}+)*"
TOKEN = rf"{NON_WS}+"
WORD_PLAIN = rf"{W}+"
SENTENCE_GAP = rf"(?<=[.!?]){WS}+(?=[\"'“‘(]?[A-Z0-9])"
LOOSE_GAP = rf"(?<=[.!?]){WS}+"
PARAGRAPH_GAP = rf"\n{WS}*\n"
RULE_LINE = r"(?md)^[ \t]*[-—–=_*]{3,}[ \t]*$"
DASH_RUN = r"—|–|-{2,}"
DASH_EDIT = r"[ \t]*(?:—|–|-{2,})[ \t]*"
DASH_EDIT_LATEX = r"[ \t]*(?:—|-{3,})[ \t]*"
FIRST_PERSON = r"^[\"'“‘(]?(?:I|I'm|I've|I'd|I'll|My)\b"

# Features in order.
SURFACE = (
    "sent_len_mean", "sent_len_stdev", "pct_short_sents", "pct_long_sents", "colons_per_100w", "semicolons_per_100w", "emdash_per_100w",
    "question_rate", "commas_per_sent", "para_len_mean", "first_person_openers", "ttr", "word_len_mean",
)
CADENCE = (
    "sl_autocorr1", "sl_autocorr2", "sl_delta_abs", "sl_delta_sd", "sl_dir_changes", "sl_run_mean", "sl_trans_entropy",
    "sl_short_after_long", "para_open_ratio", "para_close_ratio", "clause_len_mean", "clause_len_cv", "clause_per_sent",
)

# Constants of calibration, gates and rules.
Z_CLIP = 4.0
TTR_WINDOW = 400
DEFAULT_CUTS = (12.0, 22.0)
MIN_PIECE_WORDS = 120
MIN_PIECES = 5
FIT_RATIO = 1.6
FEATURE_Z, FEATURE_K = 3.0, 2
AUTHOR_DASH_MIN = 2.0
SPREAD_SAMPLE = 60

# Words and phrases that give generated text away.
TELL_WORDS = tuple(
    """delve delves delving tapestry tapestries navigate navigating navigated realm realms testament intricate intricately multifaceted holistic
    leverage leveraging leveraged unlock unlocking paradigm paradigms embark embarking foster fostering cultivate cultivating robust myriad plethora
    underscore underscores underscoring showcase showcases showcasing elevate elevating streamline streamlining comprehensive seamless seamlessly
    pivotal burgeoning empower empowering empowered transformative crucial vital essential catalyst synergy optimize optimizing optimized unleash
    unleashing beacon resonate resonates resonating align aligning aligned impactful demystify reimagine furthermore moreover additionally""".split()
)
TELL_PHRASES = (
    "in the realm of", "navigate the complexities of", "stands as a testament", "it's important to note", "it is important to note",
    "in today's fast-paced", "in today's digital", "ever-evolving landscape", "rich tapestry", "delve into", "embark on a journey",
    "shed light on", "in conclusion", "in essence", "when it comes to", "that being said", "it goes without saying", "play a crucial role",
    "play a vital role", "wealth of knowledge", "treasure trove", "deep dive", "a sense of", "an air of", "a feeling of",
    "unlock the potential", "catalyst for change", "game-changer", "look no further", "moving forward", "delve deeper", "let's dive in",
)
HEDGES_SOFT = r"(?i)\b(?:as if|almost as if|as though|sort of|kind of|in some way|in a sense|of sorts|might have been|could have been|somehow|something like|more or less|to some extent)\b"

# Numbers, citations, acronyms.
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
CITATION = r"[A-Z][a-zA-Z]+ et al\.?|\([A-Z][a-zA-Z][^)]*?[0-9]{4}[^)]*?\)|arXiv:[0-9]{4}\.[0-9]+"
ACRONYM = r"\b[A-Z][A-Z0-9]{2,}(?:-[A-Z0-9]+)?\b"
ACRONYM_SKIP = tuple("AI LLM LLMS RAG LORA QLORA GPT API CPU GPU MCP JSON PDF FTS RRF STEM ID URL IID HTTP".split())

# Sentence shapes.
TRIAD_OPENERS = ("first", "second", "third", "then", "next", "finally", "or")
TRIAD_SEQUENCE = rf"(?is)^{WS}*first\b.*?[,;]{WS}*(?:second|then)\b.*?[,;]{WS}*(?:third|then|finally)\b"
META_ASIDE = (
    rf"(?i),{WS}*which (?:is|was){WS}+(?:not{WS}+)?(?:the|a|exactly|precisely)?{WS}*(?:{W}|{WS}){{0,40}}?\b(?:i|we)\b{WS}+"
    r"(?:like|find|found|love|loved|hate|hated|prefer|preferred|think|thought|feel|felt|realize|realized|notice|noticed|want|wanted|enjoy|enjoyed)\b"
)
ABSENCE_PUNCH = rf"(?i)^(?:that|this|it|he|she|they)\b(?:{W}|{WS}){{0,25}}?\b(?:is|was|are|were){WS}+(?:gone|over|done|finished|no more|nothing|silent|still|empty)\b"
SETUP_WORDS, PUNCH_WORDS = 15, 8
LEAKAGE = (
    rf"(?im)\b(?:okay|alright|sure)[,.]?{WS}+here'?s (?:my|the|a){WS}+(?:task|answer|response|draft)\b"
    r"|\blet me (?:try to |just |)?think (?:this |it )?through\b|\bin example [0-9]\b"
    rf"|\bthe (?:topic|task|prompt|style){WS}+(?:is|was){WS}*[\"']|\bwrite a passage in the style of\b|^(?:okay|alright){WS}*,{WS}*(?:so|here|let)"
)
WH_CLEFT = (
    rf"(?i)\bWhat{WS}+{W}+(?:{WS}+{W}+){{0,6}}?{WS}+(?:is|was|does|did|shows?|showed|establishes?|finds?|found|means?|matters?|describes?|tells?){WS}+(?:is\b|that\b)"
    rf"|\bthe{WS}+{W}+(?:{WS}+{W}+){{0,3}}?{WS}+that{WS}+matters?(?:{WS}+most)?{WS}+is\b|\bThat{WS}+is{WS}+what{WS}+{W}+"
)
IT_CLEFT = (
    rf"(?i)\bIt{WS}+(?:is|was){WS}+(?!clear\b|worth\b|possible\b|true\b|not\b|only{WS}+{W}+{WS}+that\b|found\b|affirmed\b|said\b|shown\b|noted\b|argued\b"
    rf"|likely\b|believed\b|assumed\b|reported\b|thought\b|obvious\b|apparent\b|unclear\b)[^.?!,;]{{3,40}}?{WS}+that{WS}+{W}+"
)
ANTITHESIS = (
    rf"(?i)\bnot{WS}+[^.,;:]{{2,50}}?{WS}+but{WS}+(?:rather{WS}+)?{W}+|\brather{WS}+than\b|\binstead{WS}+of\b|,{WS}*not{WS}+{W}+"
    rf"|\bis{WS}+not{WS}+[^.?!]{{2,60}}?\.{WS}*(?:It|That|This){WS}+is\b"
)
FLOURISH = rf"(?i)\b(?:exactly|precisely|only|entirely){WS}+(?:where|when|what|how|the{WS}+{W}+{WS}+(?:that|where)|at{WS}+the{WS}+{W}+{WS}+(?:that|where))\b"

# Ways a person shows in prose, and their floors per 1,000 words.
PRESENCE = {
    "epistemic": rf"(?i)\b(?:we|i){WS}+(?:{W}+{WS}+){{0,2}}?(?:find|found|think|thought|believe|suspect|suspected|read|interpret|take|took|argue|argued|posit|posited|judge|judged|doubt|doubted|conclude|concluded|infer|inferred|understand|understood|hold|held|treat|treated|prefer|preferred)\b"
    r"|\b(?:suggests?|suggesting|suggested|indicates?|indicating|indicated|implies|implying)\b",
    "expectation": rf"(?i)\bsurpris{W}+\b|\bunexpected(?:ly)?\b|\bcounterintuitive\b|\bcontrary to\b|\b(?:we|i){WS}+(?:had{WS}+)?expect{W}*\b|\bwe did not expect\b|\bagainst (?:our )?expectation{W}*\b"
    rf"|\bwe went in expecting\b|\bturned out\b|\bto our surprise\b|\bruns? against\b|\bwe had (?:assumed|hoped|thought)\b|\bstriking{W}*\b",
    "stance": rf"(?i)\b(?:seems?|seemed|appears?|appeared){WS}+(?:to|that)\b|\bit seems to (?:us|me)\b|\b(?:probably|plausibly|arguably|presumably|likely|apparently)\b"
    rf"|\b(?:we|i){WS}+(?:cannot|can't|could not|do not|don't){WS}+(?:say|tell|settle|separate|show|know)\b|\bremains? open\b|\bis not settled\b|\bwe are not sure\b|\bhard to say\b",
    "signpost": rf"(?im)(?:^|\.{WS}+)(?:First|Second|Third|Finally|In summary|To summarize|In short|Regarding|Taken together|On balance|That said|By contrast|Put differently)\b",
    "agency": rf"(?i)\b(?:we|i){WS}+(?:ran|run|chose|choose|decided|decide|looked|look|went|go|tried|try|built|build|asked|ask|set out|wanted|want|dropped|drop|kept|keep|rejected|reject|withdrew|withdraw|added|add|checked|check|measured|measure|tested|test)\b",
}
WEAK_HEDGES = r"(?i)\b(?:sort of|kind of|somehow|something like|in some way|of sorts|a bit|rather more|more or less|to some extent|in a sense)\b"
FIELD_FLOOR = {"epistemic": 0.25, "expectation": 0.12}
ABSENCE_TOTAL, ABSENCE_WORDS, DENSITY_WORDS = 1.5, 220, 1500

# Closed-class words, filler, concrete anchors.
FUNCTION_WORDS = tuple(
    """a an the and or but nor so yet for of to in on at by with from into onto upon about over under again further then once here there all any both
    each few more most other some such no not only own same than too very can will just don should now is are was were be been being am do does did
    doing have has had having i you he she it we they them his her its our their this that these those as if because while when where which who whom
    whose what how why would could may might must shall s t d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan
    shouldn wasn weren won wouldn""".split()
)
FILLER = (
    r"(?i)\b(?:it is important to note(?: that)?|it should be noted(?: that)?|in order to|the fact that|due to the fact that|at this point in time"
    r"|it is worth noting(?: that)?|needless to say|as a matter of fact|for all intents and purposes|in terms of|with regard to|a number of|a variety of|in the process of)\b"
)
ANCHOR = rf"[0-9]|{W}{WS}+[A-Z][a-z]{{2,}}|[\"“'']{W}+[\"”'']|%"

# Rewrite checks.
REGISTER = {
    "contraction": rf"(?i)\b{W}+'(?:s|t|re|ve|ll|d|m)\b",
    "second person": r"(?i)\b(?:you|your|yours|yourself)\b",
    "intensifier": r"(?i)\b(?:exactly|simply|actually|really|very|indeed|precisely|quite|utterly|genuinely)\b",
    "expletive there": r"(?i)\bthere(?:'s| is| are| was| were)\b",
    "rhetorical question": r"\?",
}
NOT_JUST = rf"(?i)\b(?:not|isn't|aren't|wasn't|weren't|doesn't|don't){WS}+(?:just|merely|only|simply)\b"
COLON_HOOK = rf"^[^:]{{3,45}}:{WS}+{NON_WS}"
SCAFFOLD = r"(?im)\[(?:memory|tool|system|assistant|note|thinking|context)\b[^\]]{0,80}\]|^(?:Here(?:'s| is) (?:the|your|a)\b|Sure[,!]|Certainly[,!]|I've rewritten|Rewritten version|Note:|Output:)|^```"
CLAIM_HEDGES = r"(?i)\b(?:may|might|could|can|appears? to|seems? to|tends? to|we read|we interpret|suggests?|indicates?|largely|generally|typically|broadly|released|reported|observed|approximately|about)\b"
UNIVERSALS = rf"(?i)\b(?:never|always|every|all|none|no {W}+ (?:has|have) ever|cannot|impossible|invariably|without exception)\b"
NUMERIC_RANGE = rf"[0-9][0-9,.]*{WS}*(?:-{{2,3}}|–|—){WS}*[0-9][0-9,.]*"
SD_DROP, TAIL_DROP, LONG_WORDS, SHORT_WORDS, REGISTER_GROWTH, REGISTER_SLACK, MAX_GROWTH = 0.05, 0.34, 35, 12, 1.5, 2, 0.10
HEADING_LATEX = r"\\((?:sub){0,2}section)\*?\{([^{}]*)\}"
HEADING_MARKDOWN = r"(?md)^(#{1,6})[ \t]+(.*)$"

# Markup.
LATEX_SIGNS = r"\\(documentclass|begin\{document\}|section\*?\{|subsection\*?\{|cite[tp]?\{|label\{)"
MARKDOWN_SIGNS = r"(?md)^#{1,6}[ \t]|^```|^\|.*\|[ \t]*$"
DROPPED_ENVIRONMENTS = tuple("table table* tabular tabularx figure figure* equation equation* align align* gather gather* verbatim lstlisting minted tikzpicture thebibliography".split())

# Chunking and calibration units.
CHUNK_TARGET, CHUNK_MIN, CHUNK_CAP, PARAGRAPH_MIN = 190, 40, 350, 8
SEGMENT_WORDS, SEGMENT_MIN, SPREAD_RATIO = 1500, 400, 6.0

# Retrieval.
RRF_K, MMR_LAMBDA, BM25_K1, BM25_B, RECENCY_NUDGE = 60, 0.65, 1.2, 0.75, 0.15

# Purity audit signals, with the direction that is suspicious.
PURITY = {"emdash_per_100w": 1, "md_structure_per_1kw": 1, "tricolon_per_1kw": 1, "para_cv": -1, "sent_cv": -1}
PLACEHOLDER = r"\[(?:[A-Z][a-z]+ ){0,3}(?:Name|Title|Insert|insert|Word count|University|Company|Program|Date|X)\b[^\]]{0,60}\]"
BOLD_HEADER = rf"(?m)^{WS}*(?:\*\*.+\*\*|#{{1,4}}{WS}+{NON_WS})"
BULLET = rf"(?m)^{WS}*[-*•]{WS}+{NON_WS}"
TRICOLON = rf"\b(?:{W}|')+,{WS}+(?:{W}|')+,{WS}+and{WS}+(?:{W}|')+\b"
