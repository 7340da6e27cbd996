"""Template residue, filler and error pages instead of content.

Four detectors look at a text line by line and sentence by sentence:

* placeholders: one grammar per delimiter pair finds template fields; a field
  is unfilled residue unless it stands in code, in quotes, or in a sentence that
  talks about syntax, or its name is code rather than a field name;
* filler: running dummy text, lines that repeat a few words, stock sentences;
* error pages: status lines, server messages and error objects where a line or
  sentence begins, not in the middle of prose or in quotes;
* notices that scripts must be enabled.

What is shown in code blocks, code spans or quotes is discounted first. A text
that is a tutorial by density (most of its fields in code, several of them) is
held to a field in a line of its own or a frame of at least two fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.\-][A-Za-z0-9]+){0,5}"
#: Names with a member, an index or a filter after them.
_PATH = rf"{_NAME}(?:\.[A-Za-z_]\w*|\[\s*[\"']?[\w ]{{1,40}}[\"']?\s*\])*"
_WORDS = r"[A-Za-z]+(?:[ _\-][A-Za-z]+){0,3}"
_UPPER = r"[A-Z][A-Z0-9]*(?:[ _.\-][A-Z0-9]+){0,5}"
#: Grammars of template fields, by delimiters; group 1 is the field's name.
GRAMMARS = {
    "mustache": rf"\{{\{{\{{?\s*[#/^>&]?\s*(?:(?:if|unless|each|with)\s+)?({_PATH})(?:\s*\|[^}}\n]{{0,40}})?\s*\}}?\}}\}}",
    "dollar": rf"\$\{{\s*({_NAME})\s*\}}",
    "hash": rf"#\{{\s*({_NAME})\s*\}}",
    "erb": rf"<%[=-]?\s*({_NAME})\s*-?%>",
    "block": rf"\{{%-?\s*(?:block|include|trans|value|field)\s+[\"']?({_NAME})[\"']?\s*-?%\}}",
    "guillemets": rf"<<\s*({_NAME})\s*>>",
    "square": rf"\[\[\s*({_NAME})\s*\]\]",
    "at": rf"@@\s*({_NAME})\s*@@",
    "dunder": rf"(?<![\w])__({_UPPER})__(?!\w)",
    "percent": rf"(?<![\w%])%({_UPPER})%(?![\w%])",
    "python": rf"%\(({_NAME})\)[sd]",
    "percents": rf"%%\s*({_NAME})\s*%%",
    "percent_words": r"(?<![\w%])%([A-Za-z]+(?:_[A-Za-z]+)+)%(?![\w%])",
    "bars": rf"(?:\*\||\|\*)\s*({_NAME})\s*(?:\|\*|\*\|)",
    "bang": rf"\{{!\s*({_NAME})\s*\}}",
    "hashes": r"##([A-Z]+(?:_[A-Z]+)+)##",
    "position": r"(?<![^\s(\[:,;>\-])\{(\d{1,2})\}(?![^\s.,;:!?)\]<\-])",
    "your": rf"<\s*(?:your|insert|enter|add)\s+({_NAME})\s*>",
    "angle": rf"<({_UPPER})>",
    "todo": rf"\[\s*(?:TODO|TBD|FIXME|INSERT|ENTER|ADD|FILL IN|YOUR|PLACEHOLDER)\b\s*:?\s*({_NAME})\s*\]",
    "bracket": r"(?<![\w\]])\[([A-Z]+(?:[ _.\-][A-Z]+){0,5})\](?![\w(\[])",
    "crosses": rf"\bX{{3,}}[-_]({_UPPER})[-_]X{{3,}}\b",
    "money": rf"(?<![\w$])\$({_UPPER})\$(?![\w$])",
    "brace": r"(?<![\w{$#%\"':\\])\{([a-z][A-Za-z]*(?:[_.][A-Za-z]+)*)\}(?![\w}\"':])",
    "label": rf"(?<![\w\]!\\])\[({_WORDS})\](?![\w(\[:])",
    "label_brace": rf"(?<![\w{{$#%\"':\\=])(?<!= )\{{({_WORDS})\}}(?![\w}}\"':])",
}
#: Last words of the names of fields in letters and forms, and first words that say whose.
LABELS = frozenset(
    """name firstname lastname fullname surname date time address street city country zip email mail phone telephone company organisation organization product version
    subject amount price quantity number order account website signature position department recipient sender customer user username contact reference invoice salutation fname lname""".split()
)
OWNERS = frozenset("your insert enter add recipient customer client first last full".split())
_ENVIRONMENT = frozenset(
    """home path user username temp tmp app_root appdata localappdata userprofile systemroot windir programfiles programdata homepath comspec pwd shell lang hostname
    env_user""".split()
)
_MARKUP = frozenset("html div span table tr td th br hr p b i a ul ol li h1 h2 h3 pre code img".split())  # in forum and wiki markup too
_TAG_NAMES = _MARKUP | frozenset("body head title script style form input cdata".split())
_CODE_NAMES = frozenset("file line func function init main name_space debug".split())
_TRACES = frozenset("main function func init debug self this".split())
_EXPRESSIONS = frozenset("self this constructor.name".split())
#: Names that are no fields of a text, by the grammar in which they mean something else.
NOT_FIELDS = {
    "dollar": _ENVIRONMENT | _EXPRESSIONS, "percent": _ENVIRONMENT, "money": _ENVIRONMENT, "angle": _TAG_NAMES, "dunder": _CODE_NAMES,
    "bracket": _MARKUP | _TRACES, "brace": _MARKUP | _TRACES, "mustache": _EXPRESSIONS, "hash": _EXPRESSIONS, "erb": _EXPRESSIONS,
}
#: Sentences that talk about syntax or about such texts.
_SPEAKS = re.compile(
    r"\b(?:the (?:literal )?(?:string|variable|expression|macro|placeholder|marker|field syntax|delimiters?)s?\b|variables? (?:named|called|such as|like)|(?:environment|shell) variable|"
    r"config(?:uration)? key|is written as|are written as|evaluat(?:es|ed|ing)|scanner sends|computed value|display name|comment field|is expanded|"
    r"are expanded|resolved at|expands to|syntax|template (?:language|engine|variables?|syntax|literal)|placeholders? (?:such|like|in the|are|were|of)|"
    r"replaced (?:by|with|at)|interpolat|documentation (?:uses|shows)|for example|e\.g\.)",
    re.IGNORECASE,
)
#: Words of running dummy text.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore
    magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
    reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia
    deserunt mollit anim id est laborum""".split()
)
#: Words typed to fill space.
DUMMY = frozenset("foo bar baz qux quux asdf qwer qwerty asdfgh test testing tests 123 1234 blah bla blub blindtext muster beispiel aaa bbb ccc ddd xxx xx yyy zzz lorem ipsum".split())
#: Words that a table or log repeats.
ANSWERS = frozenset("yes no true false none null ok on off na n/a low medium high pass fail x".split())
_FILLER = re.compile(
    r"^(?:(?:this|here) is (?:just |only )?(?:a |an |some )?(?:sample|dummy|placeholder|filler|example|test)\s+(?:text|paragraph|entry|content|page|record|document|description|sentence)\b"
    r"|(?:sample|dummy|placeholder|filler|test) (?:text|paragraph|entry|content|page|record|document|description|sentence)\b(?!\s+(?:is|was|were|are|has|had|in|of)\b)"
    r"|(?:your |the |main |more )?(?:text|contents?|details|description|summary|body|copy) (?:goes here|go here|to follow|to come|to be (?:added|written|supplied|completed)|will be added|coming soon|pending)\b"
    r"|(?:insert|enter|add|put|type|write) (?:your |the |some )?(?:text|contents?|details|description|summary|copy) here\b|click (?:here )?to add (?:text|title|subtitle|notes|content)\W*$"
    r"|this (?:page|site|section|website) is (?:currently |still )?under construction\b"
    r"|(?:coming soon|under construction|to be (?:announced|added|written|completed)|tbd|todo)\W*$"
    r"|texte provisoire|à remplacer avant publication|hier steht (?:später|bald|noch)\b|testo segnaposto|texto provisional"
    r"|dies ist (?:ein )?(?:blindtext|beispieltext|platzhalter)|(?:blindtext|platzhalter(?:text)?)\b(?=[\s.:]*$)|ceci est un texte (?:de remplissage|d'exemple|factice)|texte (?:de remplissage|factice|à venir)"
    r"|este es un texto de (?:relleno|ejemplo|prueba)|texto de relleno|(?:此处|这里)(?:填写|输入|为|是)|占位(?:文本|内容|符)|(?:内容)?待补充\W*$|示例文本)",
    re.IGNORECASE,
)
_FAULTS = (
    r"(?:(?:page |file |resource |document |url |object )?not found|forbidden|bad gateway|service (?:is )?(?:temporarily )?unavailable|internal (?:server )?error|"
    r"gateway time-?\s?out|too many requests|unauthori[sz]ed|bad request|(?:upstream|connection|request|origin) timed out|request time-?out|"
    r"origin is unreachable|unexpected response|access (?:is )?denied|permission denied|gone|method not allowed|not acceptable|conflict|"
    r"(?:web )?server is down|bandwidth limit exceeded|not implemented|payment required|connection (?:refused|reset)|proxy error|rate limit(?:ed)?(?: exceeded)?)"
)
_ERROR_LINE = re.compile(
    rf"^(?:(?:error|http(?:/[\d.]+)?|status(?: code)?|code)[\s:]*)*\(?[45]\d\d\)?\s*[:|\-–—.]?\s*(?:error\s*[:|\-–—.]?\s*)?{_FAULTS}(?:[.!]?\s*(?:$|trace\b|reference\b|ray\b|\(|[-|–—]))"
    rf"|^(?:error\s*[:\-–—]\s*)?{_FAULTS}\s*\(\s*(?:error |http )?[45]\d\d\s*\)[.!]?\s*$"
    rf"|^(?:sorry|oops|whoops)\s*[,!.:\-–—]*\s*(?:an? |the )?(?:error\s*:?\s*)?{_FAULTS}[.!]?\s*$"
    rf"|^(?:access denied|gateway time-?\s?out|bad gateway|internal server error|service (?:temporarily )?unavailable|page not found|forbidden)[.!]?\s*$"
    r"|^(?:http )?error [45]\d\d[.!]?\s*$"
    r"|^traceback \(most recent call last\)|^(?:php )?(?:fatal|parse) error:\s|^uncaught (?:\w+)?(?:exception|error)\b|^unhandled exception\b"
    r"|^(?:sorry, )?the requested (?:url|page|resource|file|document|address)\b.{0,200}\b(?:was not|could not be|cannot be|is not|not) (?:found|available|located)\b"
    r"|^(?:we |the (?:site|server|application) )?(?:could|can|cannot|can't|failed to|were unable to|was unable to)\s*(?:not )?(?:connect to|reach|open|establish a connection to) (?:the |our )?database\b"
    r"|^error establishing a database connection|^(?:database|application|server|runtime) error\b.{0,40}$"
    r"|^you (?:do not|don't) have (?:permission|access|authori[sz]ation)\b.{0,60}\b(?:view|access|see|open|this|/)|^you are not (?:authori[sz]ed|allowed) to (?:view|access)\b"
    r"|^(?:this|our|the) (?:page|site|web ?site|service|portal|server|bulletin|application|system)\b.{0,30}\b(?:is|are) (?:currently |temporarily )?(?:down|offline|closed|unavailable|undergoing)\b(?:.{0,20}\bmaintenance|\W*$)"
    r"|^(?:the )?upstream server did not (?:answer|respond)|^checking your browser before|^(?:please )?(?:verify|confirm) (?:that )?you are (?:a )?human"
    r"|^the (?:document|page|file|advisory|resource) you (?:were looking for|requested|are looking for)\b|^rate limit exceeded\b|^retry after \d+ seconds"
    r"|^(?:erreur|fehler|error) \d{3}\s*[:\-–—]|^le serveur a rencontré|^(?:抱歉[，,]\s*)?您(?:访问|请求)的(?:页面|资源)|^系统(?:繁忙|错误|维护)"
    r"|^(?:oops|whoops|sorry|uh[ -]?oh)\s*[,!.:\-–—]+\s*(?:something went wrong|an? error|you have been blocked|we (?:could|can) ?n[o']t find|this page)\b|^sorry, you have been blocked\b"
    r"|^your session (?:has |is |was )?(?:expired|timed out|ended|terminated)\b|^(?:please )?(?:sign|log) ?in again\b"
    r"|^(?:we'?re |we are )?sorry,? (?:but )?an? (?:\w+ )?error (?:has )?occurred\b|^error (?:[45]\d\d|1\d{3}) ?[:\-–—]|^the server encountered an? (?:\w+ )?error\b"
    r"|^(?:database|db|sql|redis|upstream) connection (?:failed|refused|error|timed out)\b|^(?:could|can)(?:not| not) connect to (?:the )?(?:database|server|upstream|backend)\b"
    r"|^(?:the |this )?(?:page|document|file|article|content|resource) (?:you (?:are|were) looking for |you requested )?(?:does not|doesn't|no longer) exists?\W*$|^(?:the |this )?(?:page|document|file|article) (?:could not|cannot|can't) be (?:found|located)\W*$"
    r"|^(?:sidan (?:kunde inte hittas|hittades inte|finns inte)|siden (?:blev |ble )?ikke (?:fundet|funnet)|sivua ei löytynyt|(?:de )?pagina (?:is )?niet gevonden|pagina non trovata|p[áa]gina (?:não|nao) encontrada"
    r"|nie znaleziono strony|strona nie została znaleziona|stránka nenalezena|az oldal nem található|sayfa bulunamadı|страница не найдена|сторінку не знайдено)\b"
    r"|^(?:toegang geweigerd|accesso negato|acesso negado|åtkomst nekad|adgang nægtet|odmowa dostępu|přístup odepřen|erişim engellendi|доступ (?:запрещ[её]н|заборонено))\W*$"
    r"|^(?:errore|erro|fel|fout|błąd|chyba|hata|ошибка|помилка|エラー)\s*\d{3}\b|^(?:お探しの)?ページが見つかりません|^アクセスが拒否|^(?:요청하신 )?페이지를 찾을 수 없습니다|^접근이 거부"
    r"|^something went wrong\b|^an? (?:unexpected |internal |unknown )?error (?:has )?occurred\b.{0,80}$|^(?:please )?try again (?:later|in a few)\b"
    r"|^this (?:page|site) (?:can't|cannot|can’t) be (?:reached|displayed|found)|^no such (?:page|file|advisory|record)\W*$"
    r"|^(?:die )?(?:angeforderte )?seite (?:wurde )?nicht gefunden|^zugriff verweigert\W*$|^page (?:non trouvée|introuvable)|^accès refusé\W*$|^página no encontrada|^acceso denegado\W*$"
    r"|^(?:页面不存在|页面未找到|找不到(?:该)?页面|服务器(?:内部)?错误|拒绝访问|服务(?:暂时)?不可用|无法访问此网站)",
    re.IGNORECASE,
)
#: An error object up to a key of it, and what makes it one, anywhere after: a fault that is no key of a list or object, or a code.
_ERROR_OBJECT = re.compile(r"^\s*[\[{].*?[\"'](?:error|errors|message|detail|status|code)[\"']\s*:", re.IGNORECASE)
_ERROR_VALUE = re.compile(rf"[\"']\s*{_FAULTS}(?!\w*[\"']\s*:\s*[\[{{])|[\"']?(?:code|status)[\"']?\s*:\s*[\"']?[45]\d\d\b", re.IGNORECASE)
_JS = r"(?:java\s?script|scripts?|scripting|js|client-side (?:code|scripts?|scripting))"
#: What every notice contains: texts and sentences without are done.
SCRIPTS = ("script", "js", "client-side", "脚本")
#: Words that ask to switch something on, in languages other than English.
_SWITCH_ON = (
    r"(?:aktivieren|aktiviere|einschalten|activer|activez|autorisez|activar|active|activa|habilite|habilita|habilitar|ative|ativar|habilite|attiva|attivare|attivate|abilita|abilitare|abilitate"
    r"|aktivera|aktivér|aktiver|aktiviser|slå på|slå til|aktivoi|inschakelen|schakel|aanzetten|zet|włącz\w*|zapněte|povolte|engedélyezze|etkinleştirin|включите|включить|увімкніть"
    r"|benötigt|erfordert|nécessite|requiert|necesita|requiere|richiede|requer|kräver|kræver|krever|vereist|wymaga|vyžaduje|требует\w*)"
)
_NOTICE = re.compile(
    rf"^(?:please[ ,]+|you (?:need|have) to |you must |you should |kindly )?(?:re-?)?(?:enable|activate|turn on|switch on|allow) (?:the use of )?{_JS}\b(?! (?:injection|engine|file|console|code))"
    rf"|^(?:please )?(?:turn|switch) {_JS} on\b"
    rf"|^(?:(?:this|our|the|your) [\w \-]{{1,40}}?|it) (?:requires?|needs?|depends on|relies on) {_JS}\b"
    rf"|^(?:this|our|the) [\w \-]{{1,40}}? (?:only works?|works? only|only runs?|runs? only) with {_JS}\b"
    rf"|^(?:(?:this|our|the) [\w \-]{{1,40}}? )?(?:will not|won't|cannot|can't|can not|does not|doesn't) (?:load|work|run|open|start|be (?:drawn|shown|loaded|displayed|viewed|used|opened|rendered)) (?:properly |correctly )?(?:until|while|without|unless|if|because|as) .{{0,60}}\b{_JS}\b"
    rf"|^(?:this|our|the) [\w \-]{{1,40}}? works? (?:best|better) with {_JS}\b|^(?:we'?re |we are )?sorry,? but (?:this|our|the) [\w \-]{{1,40}}? (?:doesn't|does not|won't|cannot|can't) work (?:properly )?without {_JS}\b"
    rf"|^(?=.{{0,200}}\bjava\s?script\b)(?:\S+\s+){{0,12}}?{_SWITCH_ON}\b|^.{{0,80}}java\s?script\s?(?:を)?(?:有効|オン)|^.{{0,80}}java\s?script\s?(?:를|을)?\s?(?:활성화|사용)"
    rf"|^your browser (?:does not|doesn't|did not) (?:support|run|execute|allow) {_JS}\b"
    rf"|^(?:it (?:looks|seems) (?:like|that) )?{_JS} (?:is|are|seems to be|appears to be) (?:currently )?(?:turned off|disabled|not enabled|blocked|switched off|required|not available|unavailable)\b(?:\W*$| in your| by your| to | for | in this| on )"
    rf"|^(?:this|our|the) [\w \-]{{1,40}}? was (?:stopped|blocked) by your script blocker|^noscript\b|^{_JS} must be (?:allowed|enabled|turned on|switched on)"
    r"|^(?:bitte )?(?:aktivieren|schalten) sie (?:bitte )?java\s?script|^(?:diese|die) [\w \-]{1,40} (?:benötigt|erfordert) java\s?script"
    r"|^(?:veuillez|merci d['’])\s*(?:activer|autoriser) (?:le )?java\s?script|^(?:cette|ce) [\w \-]{1,30} (?:nécessite|requiert) java\s?script"
    r"|^(?:por favor,? )?(?:active|activa|habilite|habilita) (?:el )?java\s?script|^(?:esta|este) [\w \-]{1,30} (?:necesita|requiere) java\s?script"
    r"|^(?:请|需要|您需要|必须)?\s*(?:启用|开启|允许|打开)\s*(?:浏览器的?)?\s*(?:java\s?script|脚本)|^(?:本|此)(?:页面|网站|应用).{0,10}(?:需要|依赖)\s*(?:java\s?script|脚本)",
    re.IGNORECASE,
)
#: Subjects of prose about a weakness, and reports about such pages.
_PROSE = re.compile(
    r"\b(?:exploits?|attack(?:er|s)?|payloads?|proof of concept|flaws?|defects?|bug|vulnerabilit\w*|issue|weakness|crash|patch|advisory says|users? (?:were|was|are) told|"
    r"visitors?|lure|not affected|regression test|audit log|fixed builds|visible symptom|in its logs|marks a|"
    r"angreifer|schwachstelle|lücke|attaquant|faille|atacante|vulnerabilidad|falla|mitigat\w*|reduit|réduit)\b",
    re.IGNORECASE,
)
#: Names of pages and lists, in which such a word tells nothing.
_PAGE_NAMES = re.compile(r"\b(?:issue|bug|patch|exploit|vulnerability|weakness|crash|attack)\s+(?:page|tracker|report|list|id|number|entry|record|url|file|feed|details?)\b", re.IGNORECASE)
# --------------------------------------------------------------------------

_FIELDS = re.compile("|".join(GRAMMARS.values()))
_GRAMMAR_OF = dict(enumerate(GRAMMARS, 1))
#: Every field begins with one of these.
_FIELD_BEGIN = re.compile(r"[{$#<\[@_%X*|]")
#: What every field contains: texts without are done.
_FIELD_MARK = re.compile(r"[{<%@$\[]|__[A-Z]|XXX|\*\||\|\*|##")
_FENCE = re.compile(r"^(?:```|~~~).*?^(?:```|~~~)[^\n]*$", re.DOTALL | re.MULTILINE)
#: Marks that open what is shown, and what closes each or, as all but tags close in their line, ends the search.
_SPAN = re.compile(r"`|<code>|<pre>", re.IGNORECASE), {tag: re.compile(tag.replace("<", "</"), re.IGNORECASE) for tag in ("<code>", "<pre>")} | {"`": re.compile(r"[`\r\n\v\f\x85\u2028\u2029]")}
_QUOTED = re.compile("[\"“„«「]"), {a: re.compile(rf"[{b}\r\n\v\f\x85\u2028\u2029]") for a, b in ('""', "“”", "„“", "«»", "「」")}
_TAGS = re.compile(r"</?(?:html|body|head|title|h[1-6]|p|div|center|hr|br|pre|noscript|main|section|article|ul|ol|li|table|tr|td|meta|link|!doctype)\b[^<>\n]*>", re.IGNORECASE)
_INLINE = re.compile(r"</?(?:span|b|i|u|em|strong|a|font|small)\b[^<>\n]*>", re.IGNORECASE)
_STOP = re.compile(r"[.!?]\s+|[。！？]")
_LEAD = re.compile(r"^[\s>*#\-–—•|=]+(?:\d{1,2}:\d{2}\s+)?|^(?:[QA]|Re|Note|Hinweis)\s*:\s*")
_BREAK = re.compile("[\r\n\v\f\x85\u2028\u2029]")  # one by one, so that lines of marks keep their place


def _blank(text: str) -> str:
    return re.sub("[^\r\n\v\f\x85\u2028\u2029]", " ", text)


def _sentences(text: str) -> list[str]:
    found, at = [], 0
    for stop in _STOP.finditer(text):
        found.append(text[at : stop.end()])
        at = stop.end()
    found.append(text[at:])
    return found


def _fields(text: str) -> Iterator[re.Match]:
    """What ``_FIELDS.finditer`` gives, tried only where a field can begin."""
    at = 0
    for mark in _FIELD_BEGIN.finditer(text):
        if mark.start() >= at and (match := _FIELDS.match(text, mark.start())):
            at = match.end()
            yield match


def _masked(text: str, pattern: re.Pattern) -> str:
    """Text with what the pattern matches blanked out, places kept."""
    return pattern.sub(lambda m: _blank(m.group(0)), text)


def _unshown(text: str, opening: re.Pattern, closing: dict[str, re.Pattern]) -> str:
    """Text with what stands between marks blanked out, however long, places kept.

    Linear: where a mark is not closed, the same mark is not tried again.
    """
    parts, done, at, unclosed = [], 0, 0, {}
    while match := opening.search(text, at):
        mark, at = match.group(0).lower(), match.end()
        if at <= unclosed.get(mark, -1):
            continue
        end = closing[mark].search(text, at)
        if end is None or end.group(0).isspace():
            unclosed[mark] = end.start() if end else len(text)
        elif end.start() > at or len(mark) > 1:
            parts += text[done : match.start()], _blank(text[match.start() : end.end()])
            done = at = end.end()
    return "".join([*parts, text[done:]]) if parts else text


def placeholders(text: str) -> list[str]:
    """Unfilled template fields, discounting code, quotes and talk about syntax."""
    if not _FIELD_MARK.search(text):
        return []
    everywhere = sum(1 for _ in _fields(text))
    if not everywhere:
        return []
    bare = _unshown(_masked(text, _FENCE), *_SPAN)
    found: list[str] = []
    frames = 0
    for line in _BREAK.split(bare):
        if next(_fields(line), None) is None:
            continue
        unquoted = _unshown(line, *_QUOTED)
        here = []
        for sentence in _sentences(unquoted):
            fields = list(_fields(sentence))
            if not fields or _SPEAKS.search(_FIELDS.sub(" ", sentence)):
                continue
            for match in fields:
                if _is_field(_GRAMMAR_OF[match.lastindex], match.group(match.lastindex)):
                    here.append(match.group(0))
        found.extend(here)
        frames += bool(here) and (len(here) >= 2 or not re.search(r"\w{2}", _FIELDS.sub("", line)))
    if everywhere >= 4 and len(found) * 2 < everywhere and not frames:
        return []  # by density a text about templates
    return found


def _is_field(grammar: str, name: str) -> bool:
    if grammar == "position":
        return True
    if grammar.startswith("label"):
        return _is_label(name)
    plain = re.sub(r"[_\-\s]+", "_", name).strip("_").lower()
    return len(plain) > 1 and plain not in NOT_FIELDS.get(grammar, ())


def _is_label(name: str) -> bool:
    """Whether words in brackets name a field of a letter or form."""
    words = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).replace("_", " ").replace("-", " ").lower().split()
    return words[-1] in LABELS and (len(words) > 1 or name[:1].isupper()) or (len(words) > 1 and words[0] in OWNERS)


_MARKS = {ord(mark): None for mark in ".,;:!?()[]\"'*#>|-"}


def _is_dummy(words: list[str]) -> bool:
    """Running Latin, or a few words repeated over a line."""
    if len(words) < 3:
        return False
    distinct = len(set(words))
    if all(w in DUMMY or (len(w) > 1 and len(set(w)) == 1) for w in words):
        return True
    if len(words) < 6:
        return False
    if distinct <= 3 or (len(words) >= 7 and distinct <= 4) or (len(words) >= 10 and distinct <= 0.4 * len(words) and distinct <= 8):
        alphabetic = sum(map(str.isalpha, words))
        if (alphabetic == len(words) or (len(words) >= 7 and alphabetic * 3 >= len(words))) and not ANSWERS.issuperset(words):
            return True
    if len(words) < 7:
        return False
    if not LATIN.isdisjoint(words[6::7]):  # where any run of 7 has a word
        run = best = 0
        for word in words:
            run = run + 1 if word in LATIN else 0
            best = max(best, run)
        return best >= 7
    return False


def _is_error_object(line: str) -> bool:
    line = _TAGS.sub(" ", line)
    begin = _ERROR_OBJECT.match(line)
    return bool(begin and _ERROR_VALUE.search(line, begin.end()))


def _speaks_of(piece: str) -> bool:
    return bool(_PROSE.search(_PAGE_NAMES.sub(" ", piece)))


def has_dead_text(text: str) -> bool:
    """Filler, an error page, or a notice about scripts, where content belongs.

    One pass over the lines: dummy words in the line as it is, error objects, then
    what begins a sentence outside code and quotes.
    """
    plain = _masked(text, _FENCE) if "```" in text or "~~~" in text else text
    bare = _unshown(plain, *_SPAN)
    lines = _BREAK.split(bare)
    folded = bare.lower()
    scripts = any(word in folded for word in SCRIPTS)
    for line, words in zip(lines, _BREAK.split(plain.lower().translate(_MARKS))):
        if _is_dummy(words.split()):
            return True
        if ("{" in line or "[" in line) and _is_error_object(line):
            return True
        line = _unshown(line, *_QUOTED)
        if "<" in line:
            line = _TAGS.sub("\n", _INLINE.sub(" ", line))
        for piece in line.split("\n"):
            piece = _LEAD.sub("", piece).strip()
            sentences = _sentences(piece)
            for part in [piece, *sentences] if len(sentences) > 1 else sentences:
                part = part.strip()
                if not part:
                    continue
                hit = _ERROR_LINE.match(part) or (scripts and _NOTICE.match(part)) or _FILLER.match(_LEAD.sub("", part))
                if hit and not _speaks_of(part):
                    return True
    return False


def is_residue(text: str | None) -> bool:
    """Whether a text is, or contains, residue where content belongs.

    Null, empty and blank texts are no cases: they hold no residue.
    """
    if not text:
        return False
    return bool(has_dead_text(text) or placeholders(text))


@F.pandas_udf(T.BooleanType())
def residue_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(is_residue).astype(bool)


def residue_documents(documents: DataFrame, keep: bool = False) -> DataFrame:
    """``doc_id`` of the documents with residue (or, with ``keep``, of the others).

    Row-local: no shuffle beyond removing repeated ids; whole texts are read.
    A document with null text has no residue.
    """
    hit = residue_udf("text")
    found = documents.where("doc_id is not null").select("doc_id", F.coalesce(hit, F.lit(False)).alias("hit"))
    return found.where(~F.col("hit") if keep else F.col("hit")).select("doc_id").distinct()
