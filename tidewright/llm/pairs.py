"""Defective prompt and answer pairs, by ordered rules.

Each rule looks at one pair alone: no letter or digit; only the prompt again; only a refusal; broken off before
an end; another language than the prompt's. Every defect type that a pair shows is put out with its place in the
order, so that the first one can stand for the pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("empty", "copy", "refusal", "truncated", "other_language")

# Frequent function words, by which the language of a text is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with on as by from this are be it an or not which was while than can how why what does after before".split(),
    "de": "der die das und ist in den von zu mit auf für im dem nicht ein eine des sich auch an es bei nach aus wie oder wird vor seit zum wegen ohne".split(),
    "fr": "le la les de des du et est en un une que qui dans pour sur pas par au avec ce sont ne se cette après sans quel pourquoi quoi comment l d qu".split(),
    "es": "el la los las de del y es en un una que por para con no se su al lo como más o pero este desde sin sobre cuando qué según tras también".split(),
    "pt": "o a os as de do da dos e é em um uma que por para com não se no na ao como mais ou pelo até sem sobre quando são à já".split(),
    "it": "il lo gli di del della e è un che per non sono anche nel".split(),
    "nl": "de het een van en te dat voor met niet zijn aan ook wordt".split(),
}
#: How a prompt names a language, in the languages prompts are written in.
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|anglais|ingl[eé]s|inglês|английск\w*|英語",
    "de": r"german|deutsch\w*|allemand|alem[aá]n|alemão|немецк\w*|ドイツ語",
    "fr": r"french|franz[öo]sisch\w*|français|franc[eé]s|francês|французск\w*|フランス語",
    "es": r"spanish|spanisch\w*|espagnol|español|espanhol|castellano|испанск\w*|スペイン語",
    "pt": r"portuguese|portugiesisch\w*|portugais|portugu[eé]s|português|португальск\w*|ポルトガル語",
    "it": r"italian|italienisch\w*|italien|italiano|итальянск\w*|イタリア語",
    "nl": r"dutch|niederländisch\w*|néerlandais|holandés|neerlandés|holandês",
    "ru": r"russian|russisch\w*|russe|ruso|russo|русск\w*|ロシア語",
    "ja": r"japanese|japanisch\w*|japonais|japonés|japonês|японск\w*|日本語",
    "zh": r"chinese|chinesisch\w*|chinois|chino|chinês|китайск\w*|中国語|中文",
}
# Phrases of sentences that decline, and of sentences that may stand beside them.
REFUSALS = (
    r"\bi (?:really |simply |just )?(?:can(?:not|['’]?t| not)|won['’]?t|will not|am (?:not able|unable)|['’]?m (?:not able|unable|not allowed|not permitted)|am not (?:allowed|permitted)|must not|may not|could not|couldn['’]t|do not|don['’]t) (?:be able to |wish to |want to |feel (?:able|comfortable) )?(?:to )?(?:\w+ )?(?:help|assist|provide|answer|discuss|comply|fulfil|do that|talk|describe|explain|share|comment|respond|support|offer|give|say|go into|continue|process|engage)",
    r"\b(?:i (?:have|need|must|will have|am going) (?:to )?(?:\w+ )?(?:decline|refuse|pass on)|i must (?:\w+ )?(?:decline|refuse|pass)|i (?:\w+ )?(?:decline|refuse) to|i would rather not|i['’]d rather not|i prefer not to)\b",
    r"\b(?:ask|contact|consult|find|try) (?:someone|somebody|anyone) else\b", r"\bmy (?:guidelines|rules|instructions|policies|policy) (?:do not|don['’]t|does not|prevent|forbid|prohibit)", r"\bnot be appropriate for me to\b",
    r"\boutside (?:of )?(?:what i am allowed|my|the scope)", r"\b(?:against|not permitted by|prohibited by) my (?:guidelines|rules|policy)", r"\bas an ai(?: language model)?,? i (?:can|am|do)",
    r"\bkann ich (?:\w+ ){0,4}nicht (?:\w+ )?(?:helfen|beantworten|weiterhelfen|antworten|eingehen|unterstützen|besprechen)", r"\bich kann (?:\w+ ){0,6}(?:nicht|keine?n?) (?:\w+ ){0,3}(?:helfen|beantworten|antworten|geben|weiterhelfen|eingehen|unterstützen|besprechen)",
    r"\bich darf (?:\w+ ){0,4}(?:keine?n?|nicht)\b", r"\bich muss (?:\w+ ){0,6}ablehnen", r"\bich möchte (?:\w+ )?(?:lieber )?nicht\b", r"\b(?:vorgaben|richtlinien|regeln) (?:lassen|erlauben|verbieten|untersagen|gestatten)", r"\bnicht in der lage\b", r"\bbitte (?:fragen|wenden) sie (?:sich )?(?:an )?jemand(?:en)? ander", r"\bmuss ich (?:\w+ ){0,6}(?:ablehnen|passen)\b", r"\b(?:lehne|weigere) ich\b|\bich (?:lehne|weigere)\b",
    r"\bje ne (?:peux|puis|suis|souhaite|veux|dois|saurais|pourrai) (?:malheureusement )?pas\b", r"\bne m['’](?:autorise|permet)\w* pas\b", r"\bm['’]interdi\w+", r"\b(?:décliner|refuser) (?:de|cette|ce|la|votre|d['’])", r"\bil m['’]est impossible\b", r"\bje (?:préfère|préférerais) ne pas\b", r"\bje (?:refuse|décline)\b", r"\badress\w+[- ]vous à quelqu['’]un d['’]autre", r"\bdemander à quelqu['’]un d['’]autre",
    r"\bno (?:puedo|podré|podría|debo|quiero|deseo|me es posible|me está permitido|estoy autorizad\w+|estoy en condiciones|voy a)\b", r"\bmis (?:normas|reglas|directrices|instrucciones|pautas) (?:no|me|prohíben|impiden)", r"\b(?:tengo que|debo|he de) (?:rechazar|declinar|negarme)", r"\bprefiero no\b|\bpreferiría no\b", r"\bme niego a\b",
    r"\bnão (?:posso|poderei|poderia|devo|quero|me é possível|estou autorizad\w+|consigo|vou)\b", r"\b(?:minhas|as minhas) (?:regras|diretrizes|instruções|orientações|normas) (?:não|me|proíbem|impedem)", r"\b(?:tenho de|tenho que|devo|preciso) (?:recusar|declinar)", r"\bprefiro não\b|\bpreferia não\b", r"\brecuso-me\b",
    r"(?:я )?не (?:могу|буду|смогу|имею права)\b", r"вынужден\w* отказать", r"мои правила не позволяют", r"(?:お答え|回答|お手伝い|対応|説明|提供)(?:は|を)?(?:でき|いたしかね|しかね)", r"申し訳(?:ありません|ございません)が", r"(?:无法|不能)(?:回答|提供|帮助|协助)",
)
CLOSERS = (
    r"^(?:i['’]?m |i am )?(?:very |so |really )?sorry\b", r"^(?:unfortunately|regrettably|sadly|apologies|my apologies|i apologi[sz]e|thanks? (?:you )?for)", r"^please (?:contact|ask|reach|consult|try|see|feel free)", r"is there anything else", r"(?:anything|something) else (?:i can|you)", r"^let me know",
    r"^(?:es tut mir leid|tut mir leid|leider|entschuldig|danke|bitte wenden|bitte kontaktieren)", r"ihnen (?:sonst )?(?:noch )?(?:helfen|weiterhelfen)", r"^(?:désolé|je suis désolé|malheureusement|merci)", r"puis-je vous aider|autre chose|contactez|veuillez contacter",
    r"^(?:lo siento|lamentablemente|por desgracia|desgraciadamente|perdón|disculp|gracias)", r"ayudar\w* en (?:otra cosa|algo más)|algo más|póngase en contacto|contacte", r"^(?:lamento|desculp|infelizmente|sinto muito|obrigad)", r"ajudar (?:em|com) (?:mais|outra)|mais alguma coisa|contacte|entre em contato|fale com",
    r"^(?:извините|простите|к сожалению)", r"обратитесь", r"^(?:申し訳|すみません|残念)",
)
#: Words that no sentence ends with.
DANGLING = frozenset(
    "the a an of and or to in for with on as by from at that which while because behind beneath into under over if than but der die das und oder dem den des ein eine einen weil dass mit von zu für auf im als le la les des du de et ou un une que qui parce pour dans sur avec par el los las del y o una porque para con por en os as do da dos das e um uma porque para com por no na и в на с по для что".split()
)
LABELS = r"(?:q|a|question|prompt|user|human|input|task|query|request|frage|aufgabe|anfrage|nutzer|benutzer|utilisateur|demande|tâche|pregunta|tarea|usuario|consulta|pergunta|tarefa|usuário|pedido|вопрос|задача|質問|you asked|you said|your question|repeat|answer|antwort|réponse|respuesta|resposta)"

_KANA, _HAN = regex.compile(r"[\p{Hiragana}\p{Katakana}]"), regex.compile(r"\p{Han}")
_SCRIPTS = {k: regex.compile(rf"\p{{{v}}}") for k, v in {"ru": "Cyrillic", "ar": "Arabic", "he": "Hebrew", "ko": "Hangul", "el": "Greek", "hi": "Devanagari"}.items()}
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
_LANGUAGES_OF: dict[str, list[str]] = {}
for _name, _words in FUNCTION_WORDS.items():
    for _w in set(_words):
        _LANGUAGES_OF.setdefault(_w, []).append(_name)
_NOT_ALNUM = re.compile(r"[\W_]+")
_ASKED = {k: regex.compile(rf"(?<!\p{{L}})(?:{v})(?!\p{{L}})", regex.I) for k, v in LANGUAGE_NAMES.items()}
_ORDERS = regex.compile(r"(?<!\p{L})(?:translat\w*|reply|answer|respond|write|übersetz\w*|antwort\w*|schreib\w*|tradui\w*|répond\w*|écri\w*|traduc\w*|traduz\w*|respond\w*|escrib\w*|escrev\w*|ответ\w*|перевед\w*|翻訳|答え)", regex.I)
_REFUSAL = regex.compile("|".join(REFUSALS), regex.I)
_CLOSER = regex.compile("|".join(CLOSERS), regex.I)
_QUOTED = regex.compile(r"“[^”]*”|\"[^\"]*\"|«[^»]*»|„[^“]*“|`[^`]*`")
_SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+|\n+")
_LABEL = regex.compile(rf"(?m)^[\s>*#_\"“'-]*{LABELS}\s*\d*\s*(?:\*\*)?\s*[:：.)-](?:\*\*)?\s*", regex.I)
_MARKUP = regex.compile(r"```[\w+-]*|<[^<>]{1,40}>")
_CODE = regex.compile(r"(?s)```.*?(?:```|$)")
_ITEM = regex.compile(r"^\s*(?:[-*•+–]|\d+[.)])\s+\S")
_END = regex.compile(r"[.!?。！？…][\s\"'”’»)\]*_`›]*$")
_LATIN, _OTHER_LETTER = regex.compile(r"\p{Latin}{2}"), regex.compile(r"[\p{L}--\p{Latin}]", regex.V1)
_SHORT = regex.compile(r"^(?:[\p{Sc}+-]?\s?\d[\d\s.,:/%-]*\s*[\p{L}%°\p{Sc}]{0,12}|yes|no|ja|nein|oui|non|sí|si|sim|não|да|нет|はい|いいえ|true|false|none|ok|okay|maybe)$", regex.I)


_OPENERS = frozenset("([{（［｛「『【“„«‚")
#: Which marks a mark closes; German closes by the mark that English opens with.
_CLOSES = {")": "(", "]": "[", "}": "{", "）": "（", "］": "［", "｝": "｛", "」": "「", "』": "『", "】": "【", "”": "“„", "“": "„", '"': '"„“', "»": "«»", "«": "»", "’": "‘‚", "‘": "‚"}
_DELIMITER = regex.compile("[" + regex.escape("".join(sorted({*_OPENERS, *_CLOSES}))) + "]")
# inline code, escaped signs, faces, half-open intervals and inches open nothing
_NO_OPENER = regex.compile(r"`[^`\n]*`|\\.|(?<!\w)[:;=]-?[(\[{]|[\[(][^\[\]()\n]{1,20}[,;][^\[\]()\n]{1,20}[\])]|(?<=\d)\"(?=\s|[x×.,;)]|$)")


#: Words of which every refusal in a Latin script has one.
_REFUSAL_WORDS = frozenset(
    "i my me else outside against ai ich vorgaben richtlinien regeln lage jemand jemanden je ne m décliner refuser quelqu no mis rechazar declinar negarme prefiero preferiría niego não minhas recusar prefiro preferia recuso".split()
)


def _words(text: str) -> list[str]:
    """Lower-case words, cut at apostrophes."""
    return [x for w in _WORD.findall(text.lower().replace("’", "'")) for x in (w.split("'") if "'" in w else (w,))]


def language(text: str, words: list[str] | None = None) -> str | None:
    """The language a text is most clearly in: by script, else by function words; None if it can't be told.

    ``words`` are those of the text, if the caller has them.
    """
    if "`" in text or "<" in text:
        text, words = _MARKUP.sub(" ", _CODE.sub(" ", text)), None
    if not text:
        return None
    if max(text) > "\u036f":  # letters of another script than Latin, or mere signs
        letters = sum(map(str.isalpha, text))
        kana, han = len(_KANA.findall(text)), len(_HAN.findall(text))
        if letters and (kana + han) * 3 > letters:
            return "ja" if kana else "zh"
        for name, script in _SCRIPTS.items():
            if len(script.findall(text)) * 2 > letters > 0:
                return name
    score = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in _words(text) if words is None else words:
        for k in _LANGUAGES_OF.get(w, ()):
            score[k] += 1
    first, second = sorted(score, key=lambda k: -score[k])[:2]
    return first if score[first] >= 2 and score[first] > score[second] else None


def _bare(text: str) -> str:
    return _NOT_ALNUM.sub("", _MARKUP.sub(" ", text).casefold())


def is_copy(prompt: str, answer: str) -> bool:
    """Only the prompt's letters and digits, once or several times, labels aside."""
    own = _bare(prompt)
    if not own:
        return False
    for text in {answer, _LABEL.sub("", answer)}:
        got = _bare(text)
        if got and len(got) % len(own) == 0 and got == own * (len(got) // len(own)):
            return True
    return False


def is_copied_part(prompt: str, answer: str) -> bool:
    """Most of the prompt from its start and nothing else, or the whole prompt and hardly anything more."""
    own, got = _bare(prompt), _bare(_LABEL.sub("", answer))
    if len(got) <= len(own):
        return 2 * len(got) > len(own) and len(own) >= 12 and own.startswith(got)
    return len(own) >= 12 and 5 * (len(got) - len(own)) <= len(own) and got.startswith(own)


def is_refusal(answer: str) -> bool:
    """Every sentence declines or is a courtesy, and one declines."""
    # what is quoted is spoken of, not said
    parts = [p.strip(" \t*_>#-") for p in _SENTENCE.split(_QUOTED.sub(" ", _MARKUP.sub(" ", answer)).strip())]
    parts = [p for p in parts if any(c.isalnum() for c in p)]
    refused = False
    for p in parts:
        if _REFUSAL.search(p):
            refused = True
        elif not _CLOSER.search(p):
            return False
    return refused


def is_open(answer: str) -> bool:
    """Ends inside a code fence, a bracket or a quotation."""
    if answer.count("```") % 2:
        return True
    text = _NO_OPENER.sub(" ", _CODE.sub(" ", answer))
    held: list[str] = []
    for m in _DELIMITER.finditer(text):
        c, at = m[0], m.start()
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        starts = not before or before.isspace() or before in "([{"
        own = next((i for i in range(len(held) - 1, -1, -1) if held[i] in _CLOSES.get(c, "")), -1)
        if own >= 0 and not (c in "\"“" and held[own] == c and before in ("", "\n")):  # an opening mark is repeated at each paragraph of a quotation
            del held[own:]
        elif c in held and c in "\"“«‘":
            continue
        elif c in _OPENERS or c in "\"»‘" and starts and not (after.isspace() or c == "‘" and not after.isalpha()):
            held.append(c)
    return bool(held)


def is_truncated(answer: str) -> bool:
    """Breaks off inside code, a bracket, a quotation or a sentence; short replies, lists, links and closed code are complete."""
    text = answer.strip().strip("​﻿").strip()
    if is_open(text):
        return True
    if text.endswith("```"):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    words = _WORD.findall(last)
    tail = words[-1].lower() if words else ""
    if _ITEM.match(lines[-1]) and (len(lines) > 1 or not _WORD.search(last)):
        return not _END.search(last) and (tail in DANGLING or last[-1] in ",;:([{—–-/")
    if _END.search(text):
        return False
    if _SHORT.match(text):
        return False
    if regex.search(r"https?://\S+$|\S+@\S+\.\p{L}+$", text):
        return False
    if text[-1] in "}];" and len(lines) > 1:  # code without a fence
        return text.count("{") > text.count("}") or text.count("(") > text.count(")")
    if len(words) == 1 and len(lines) == 1 and tail not in DANGLING and text[-1].isalnum():
        return False  # one word for an answer
    if text[-1] in "\"”»" and len(lines) == 1 and text[0] in "\"“«„":
        return False  # a quotation as a whole
    return True


def breaks_off(answer: str) -> bool:
    """Shows it by more than a missing last mark: an open delimiter, or a last word or sign that something must follow."""
    words = _WORD.findall(answer)
    last = answer.strip()[-1:]
    return is_open(answer) or last in ",;([{" or last.isalpha() and words[-1].lower() in DANGLING


#: Languages of one script, as far as texts without enough function words can tell.
_SCRIPT_OF = {"ja": "cjk", "zh": "cjk", **{k: k for k in _SCRIPTS}}


def is_other_language(prompt: str, answer: str, words: list[str] | None = None) -> bool:
    """In a language or a script that is neither the prompt's nor one that the prompt asks for."""
    got = language(answer, words)
    own = language(prompt) if got else None
    if got == own or got is None:
        return False
    if own is None:  # too few words for the language: the scripts must differ
        if _SCRIPT_OF.get(got) is None or not _LATIN.search(prompt) or _OTHER_LETTER.search(prompt):
            return False
    rx = _ASKED.get(got)
    return not (rx and rx.search(prompt) and _ORDERS.search(prompt))


def defects(prompt: str | None, answer: str | None) -> list[str]:
    """All defect types in their order; every rule is asked, whatever the others say.

    What is empty or a copy may lack its last mark, so there only an open end tells that it breaks off.
    """
    if answer is None or not any(c.isalnum() for c in answer):
        return ["empty", "truncated"] if answer and is_open(answer) else ["empty"]
    prompt = prompt or ""
    copy = is_copy(prompt, answer)
    words = _words(answer)
    latin = not words or max(words) < "\u0370"
    fired = {
        "copy": copy,
        "refusal": not (latin and _REFUSAL_WORDS.isdisjoint(words)) and is_refusal(answer),
        "truncated": breaks_off(answer) if copy else is_truncated(answer),
        "other_language": is_other_language(prompt, answer, words),
    }
    out = [d for d in ORDER if fired.get(d)]
    if fired["truncated"] and not copy and is_copied_part(prompt, answer):
        out.append("copy")  # a copy that breaks off: first of all it is truncated
    return out


def completions(df: DataFrame) -> DataFrame:
    """pair_id, prompt (last message of role user), answer (of the choice with index 0)."""
    users = F.filter("messages", lambda m: F.lower(m["role"]) == "user")
    zero = F.filter("choices", lambda c: c["index"] == 0)
    prompt = F.get(users, F.size(users) - 1)["content"]
    return df.select(F.col("completion_id").alias("pair_id"), prompt.alias("prompt"), F.get(zero, F.lit(0))["message"]["content"].alias("answer"))


def runs(df: DataFrame) -> DataFrame:
    """pair_id, prompt (task), answer (final_answer)."""
    return df.select(F.col("run_id").alias("pair_id"), F.col("task").alias("prompt"), F.col("final_answer").alias("answer"))


def judge(pairs: DataFrame) -> DataFrame:
    """source, pair_id, defect, place (0 for a pair's first defect): one row per defect of each pair.

    ``pairs`` has source, pair_id, prompt and answer. Null prompts are empty ones, null answers are ``empty``.
    Exact copies of a pair count once; extra columns are ignored; pairs without defect give no row.
    """
    rows = pairs.select("source", "pair_id", "prompt", "answer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [defects(p, a) for p, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            row = pa.array([i for i, own in enumerate(every) for _ in own], pa.int32())
            kinds, places = pa.array([d for own in every for d in own], pa.string()), pa.array([n for own in every for n in range(len(own))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), kinds, places], ["source", "pair_id", "defect", "place"])

    found = rows.mapInArrow(run, f"source string, pair_id {dict(rows.dtypes)['pair_id']}, defect string, place int")
    return found.dropDuplicates()  # copies of a pair; texts are not moved
