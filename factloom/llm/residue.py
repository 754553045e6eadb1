"""Template residue and error-page text.

Every text is cut into messages (lines, then sentences); numbers, addresses and dates are masked, the rest is
normalised, and equal messages are grouped across all sources by their exact hash.  Each distinct message is classified
once, by phrase rules; a short message without the form of a sentence counts as title or menu words, and a message that
no rule names is adopted as notice text only where it recurs widely and never beside report text.  A record is residue
when all its messages are notices, filler or titles and one of them is more than a title, or when a placeholder stands
anywhere in its text.

Null and empty texts are no residue; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.joins import lookup_join
from factloom.plans.staging import Stage

#: An unnamed message is adopted from so many records and sources on.
MIN_RECORDS, MIN_SOURCES = 5, 2
TITLE_LENGTH = 80
#: Tasks over which a message that stands in many records is spread where its kind is looked up by a shuffle.
SALTS = 8

# Marks of unfilled fields that mean nothing else.
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_. -][A-Za-z0-9]+)*"
PLACEHOLDERS = [
    rf"\{{\{{\s*{_NAME}\s*\}}\}}", rf"\[\[\s*{_NAME}\s*\]\]", rf"[$#]\{{\s*{_NAME}\s*\}}", r"\{\s*[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*\s*\}", r"\{\d{1,2}\}",
    rf"<%=?\s*{_NAME}\s*%>", r"%%\s*[A-Za-z][A-Za-z0-9_]*\s*%%", r"%\([a-z_]+\)[sd]", r"@@\s*[A-Za-z][A-Za-z0-9_]*\s*@@", r"(?<![\w_])__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__(?![\w_])",
    r"[<\[{«]\s*(?i:(?:please )?(?:insert|enter|your|add|fill in|type))\s[^<>\[\]{}«»]{1,60}[>\]}»]", r"[<\[{«][^<>\[\]{}«»]{1,60}(?i:goes here|to be (?:inserted|completed|added|filled in))\s*[>\]}»]",
    r"[<\[«][a-z][a-z0-9]*(?:_[a-z0-9]+)+[>\]»]", r"[<\[«][A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+[>\]»]",
]
# Fields that also serve as plain words, in marks that also serve other ends.
FIELDS = "address|amount|author|body|city|company|content|country|currency|date|department|email|field|heading|location|month|name|number|organisation|organization|period|phone|place|position|product|project|quarter|reference|region|report|signature|source|subject|summary|text|title|topic|unit|url|value|year"
PLACEHOLDERS.append(rf"[<\[«](?:{FIELDS})[>\]»]")

# Lower-case words of the usual filler text.
LOREM = "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lacus lorem magna mauris minim mollit nisi non nostrud nulla occaecat officia pariatur praesent pretium proident qui quis reprehenderit sed sint sit sunt tempor tortor ullamco ut velit veniam vestibulum viverra volutpat voluptate"
_SCRIPT = r"(?:java ?script|js|scripts?|scripting|cookies)"
_PLACE = r"(?:text|sentence|paragraph|caption|sub ?title|title|headings?|box|block|chart|image|picture|photo|content|summary|message|key message|body|here|note|section|slide)"
# Whole messages, lower-cased and masked (numbers are 0).
SCRIPTS = [
    rf"(?:you (?:need|have) to |you must |please )?(?:enable|activate|turn on|switch on|allow|unblock) (?:\w+ ){{0,2}}{_SCRIPT}\b.*", rf"(?:switch|turn) {_SCRIPT} (?:back )?on\b.*", rf"(?:\w+ and )?{_SCRIPT} (?:must|have to|has to|should|need to) be .*",
    rf"(?:cookies and |java ?script and )?{_SCRIPT} (?:is|are) (?:turned off|switched off|disabled|blocked|needed|required|not enabled|not available|not supported|off)\b.*",
    rf".*\b(?:cannot|can not|can't|could not|will not|won't) (?:be )?(?:drawn|shown|displayed|loaded|rendered|opened|run|work)\b.*\b(?:without|because|unless|until)\b.*{_SCRIPT}.*",
    rf"to (?:see|view|read|open|use|continue)\b.*\b(?:allow|enable|activate|turn on|switch on)\b.*{_SCRIPT}.*", rf".{{0,40}}\b(?:requires?|needs?) {_SCRIPT}\b.{{0,40}}", rf"this is a {_SCRIPT}[- ](?:driven|based|only) .*", r"without (?:it|them|this)\b.*\b(?:stay|remain|be) (?:empty|blank|hidden)\.?",
    r"(?:checking|verifying) your browser\b.*", r"your browser (?:does not|doesn't|settings|is|has|must|blocks|cannot)\b.*", r"no ?script\b.*",
    r".*java ?script.{0,30}(?:aktivieren|einschalten|erlauben).*|.*(?:aktivieren|schalten|erlauben) sie.{0,20}java ?script.*", r".*(?:activer|autoriser|activez) .{0,12}java ?script.*", r".*(?:active|activar|habilite|habilitar|permita) .{0,12}java ?script.*",
    r".*(?:请|需要|必须)?(?:启用|开启|允许|啟用) ?java ?script.*", r".*java ?script ?(?:を)?(?:有効|オン).*", r".*(?:تفعيل|تمكين|تشغيل) java ?script.*", r".*java ?script ?(?:को )?(?:चालू|सक्षम|सक्रिय).*", r".*(?:เปิดใช้งาน|เปิดใช้|เปิด) ?java ?script.*",
]
_CODE = r"(?:not found|bad gateway|internal server error|service (?:temporarily )?unavailable|gateway time-?out|forbidden|unauthori[sz]ed|bad request|too many requests|request time-?out|gone|moved permanently|method not allowed|precondition failed)"
ERRORS = [
    rf"(?:http )?(?:error )?(?:0:? )?(?:- )?{_CODE}(?: ?[(:\-–].*)?[.!]?", r"(?:http )?error(?: code)?:? 0\b.*", r"\(0\)",
    r".*\b(?:has|have) (?:been moved or (?:renamed|deleted|removed)|moved or no longer exists?|expired|reached its request limit|been (?:rate limited|blocked|logged out|signed out|temporarily blocked))\b.*",
    r".*\b(?:could not|cannot|can't|couldn't) be (?:found|located|opened|loaded|displayed|reached|retrieved|processed|completed)\b.*", r".*\b(?:did not|didn't) (?:respond|answer|load|reply)(?: in time)?\.?", r".*\breturned an? (?:empty|invalid|unexpected) (?:response|answer|result)\.?",
    r".*\bis (?:closed for maintenance|down for maintenance|no longer available|not available at this address|temporarily unavailable|currently unavailable|under maintenance|corrupt and could not be opened)\b.*", r".*\bcan be (?:opened|viewed|read|seen) (?:by|only by) (?:signed-in|registered|logged-in|authori[sz]ed)\b.*",
    r".*\b(?:do not|don't) have (?:permission|access|the rights?)\b.*", r"(?:access|permission|request|connection) (?:denied|blocked|refused|reset|rejected|failed|timed out|lost|closed)[.!]?.*", r"(?:query|request|download|upload|loading|page load|connection|login) failed[.!]?.*",
    r"(?:log ?in|sign[- ]?in|authentication|subscription|registration|permission) (?:is )?required[.!:]?.*", r"(?:invalid|expired|missing|unknown) (?:\w+ ){0,2}(?:token|session|link|request|address|key|page|id|credentials)[.!]?", r"page (?:missing|not found|unavailable|expired)[.!]?",
    r".*\b(?:an?|the) (?:unexpected|unknown|internal) (?:error|problem|condition)\b.*", r"(?:oops|sorry|whoops|uh oh)[,.! ].*|oops|sorry|whoops", r"(?:we're|we are) sorry\b.*", r".*something went wrong\b.*", r"nothing to see here[.!]?",
    r".*you have been (?:rate limited|blocked|logged out|signed out)\b.*", r"(?:your )?session (?:has )?(?:expired|timed out|ended).*", r"traceback \(most recent call last\):?", r"file \".*\", line 0.*", r"(?:[a-z_.]+)?(?:error|exception)(?:: .*)", r"at [a-z_$.]+\([^()]*\)",
    r".*(?:seite wurde nicht gefunden|nicht (?:erreichbar|verfügbar|gefunden)\.?$|zugriff verweigert|sitzung ist abgelaufen).*", r".*(?:page (?:demandée )?est introuvable|page introuvable|accès refusé|session a expiré|service (?:est )?indisponible|n'est pas disponible\.?$).*",
    r".*(?:no se ha encontrado|no se encontró|servicio no está disponible|acceso denegado|sesión ha (?:caducado|expirado)).*", r".*(?:找不到您|页面不存在|无法找到|无法访问|访问被拒绝|服务(?:暂时)?不可用|会话已过期).*", r".*(?:ページは見つかりません|ページが見つかりません|アクセスが拒否|サービスは(?:現在|一時的に)?利用できません|セッションの有効期限).*",
    r".*(?:الصفحة المطلوبة غير موجودة|الصفحة غير موجودة|تم رفض الوصول|الخدمة غير متاحة|انتهت الجلسة|انتهت صلاحية).*", r".*(?:पृष्ठ नहीं मिला|पेज नहीं मिला|पहुँच अस्वीकृत|सेवा (?:अभी )?उपलब्ध नहीं|सत्र समाप्त).*", r".*(?:ไม่พบหน้า|การเข้าถึงถูกปฏิเสธ|ไม่สามารถให้บริการ|เซสชันหมดอายุ).*",
]
_SHORT = rf"(?:(?:your|sample|example|dummy|placeholder) (?:\w+ )?{_PLACE}(?: (?:goes )?here)?|{_PLACE} goes here)[.!]? ?"
_ASKS = rf"(?:click|tap|double[- ]click|press)(?: here)? to (?:add|edit|insert|enter|type|change)\b.*|(?:replace|insert|add|write|type|enter|paste|put)(?: (?:this|your|a|an|the|some|own|short|brief|new|main)){{0,3}} {_PLACE}\b.*"
FILLERS = [
    rf"(?:{_SHORT})*(?:{_ASKS})?",
    r"(?:tbd|tba|tbc|todo|to be (?:determined|completed|added|confirmed)|n/a)[.!]?(?: (?:tbd|tba|tbc|todo)[.!]?)*",
    r".*(?:beispieltext|platzhaltertext|blindtext|mustertext).{0,20}", r".*(?:texte? d['’]exemple|texte de remplacement|texte à remplacer).{0,20}", r".*(?:texto de (?:ejemplo|muestra|relleno|prueba)).{0,20}", r"(?:示例文本|在此输入文本|占位文本|请在此输入).{0,12}", r"(?:サンプルテキスト|ここにテキスト|ダミーテキスト).{0,16}", r"(?:نص تجريبي|نص نموذجي|أدخل النص هنا).{0,16}", r"(?:नमूना पाठ|उदाहरण पाठ|यहाँ पाठ लिखें).{0,16}", r"(?:ข้อความตัวอย่าง|ใส่ข้อความที่นี่).{0,16}",
    r"([a-z]{1,5})(?: \1){1,}", r"(?:asdf|qwerty|qwertz|xxx+|zzz+|text|foo|bar|baz|blah|bla|test|testing|abc)(?: (?:asdf|qwerty|qwertz|xxx+|zzz+|text|foo|bar|baz|blah|bla|test|testing|abc))*[.!]?",
]
HELPERS = [
    r"(?:please )?(?:try|check|come) (?:again|back)\b.*", r"(?:go|return|get) (?:back )?to the\b.*", r"(?:please )?check the (?:address|link|url|spelling)\b.*", r"if (?:the|this) (?:problem|error|issue) (?:persists|continues)\b.*", r"(?:please )?contact (?:the|your|our)? ?(?:system )?(?:support|administrator|help ?desk|site owner)\b.*", r"(?:incident|reference|request|error|ticket|trace|case|support)(?: (?:id|code|number|no))?[ :#]*[0x-]+[0a-f-]*\.?",
    r"(?:please )?(?:sign|log) in(?: again)?\b.*", r"loading(?:…|\.\.\.)?", r"please wait.*", r".*bitte versuchen sie es\b.*", r".*(?:réessayer|veuillez vous reconnecter|réessayez).*", r".*inténtelo (?:de nuevo|más tarde).*", r"请(?:稍后|重新).{0,20}", r"(?:後で|しばらくして|もう一度).{0,30}", r"(?:يرجى المحاولة|حاول مرة).{0,30}", r"(?:कृपया (?:बाद में|पुनः|फिर)).{0,30}", r"(?:กรุณาลอง|โปรดลอง).{0,30}",
]
# Beginnings of words of which every rule in Latin letters needs one, but for those of filler words.
CUES = (
    "script java noscript js cookies browser without found gateway server unavailable time timed forbidden unauthori bad request too gone moved not precondition error fehler erreur expired limit blocked logged signed could cannot can couldn "
    "did didn returned is no temporarily currently under corrupt permission access denied refused reset rejected failed lost closed log login sign authentication subscription registration invalid missing unknown unexpected internal oops sorry whoops uh "
    "something nothing session traceback file exception at nicht verweigert abgelaufen introuvable refusé indisponible disponible está denegado sesión click tap double press replace insert add write type enter paste put your sample example dummy "
    "placeholder goes tbd tba tbc todo to asdf qwert xxx zzz blah test try check come go return get if contact incident reference ticket trace case support please loading wait bitte réessay veuillez inténtelo "
    "beispieltext platzhaltertext blindtext mustertext texte texto http https you we don have has do an the page query download upload connection"
).split()
# Words of the list above that stand in most report messages too, so that a rule needs more than them.
_PLAIN = frozenset("is no to at not an the has have do can if time type case under without get put return page to could did file log go come add check support found limit error you we at press request access file go sign".split())
# The same for other scripts.
_OTHER = "错误|找不|不存在|无法|拒绝|不可用|会话|启用|开启|啟用|请|示例|输入|占位|ページ|アクセス|サービス|セッション|サンプル|ここに|ダミー|後で|しばらく|もう一度|エラー|الصفحة|رفض|الخدمة|انتهت|تفعيل|تمكين|تشغيل|نص |أدخل|يرجى|حاول|خطأ|नहीं मिला|अस्वीकृत|उपलब्ध|समाप्त|चालू|सक्षम|सक्रिय|नमूना|उदाहरण|यहाँ|कृपया|ไม่พบ|ปฏิเสธ|ไม่สามารถ|หมดอายุ|เปิดใช้|ข้อความ|กรุณา|โปรด"
_CUE = r"\b(?:" + "|".join(sorted(set(CUES) - _PLAIN, key=len, reverse=True)) + r")|\b(?:error|found|request|file|n/a|no se|text|foo|bar|baz|bla|abc|go back|go to|get back|return to|check the|without (?:it|them|this)|did not|no longer|time-?out|under maintenance|is closed|access denied|could not|log ?in|sign[- ]?in|page)\b|^\(0\)$|^([a-z]{1,5})(?: \1)+$|^at "
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"


def _any(patterns: list[str]) -> str:
    return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"


def has_placeholder(text: Column) -> Column:
    """Whether a text holds an unfilled field; null for null."""
    return text.rlike("|".join(f"(?:{p})" for p in PLACEHOLDERS))


def messages(text: Column) -> Column:
    """The distinct messages of a text, masked and normalised; blank and bare-number messages are left out."""
    masked = F.lower(text)
    masked = F.regexp_replace(masked, r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+", "@")
    masked = F.regexp_replace(masked, rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s(?:{_MONTHS})\s\d{{4}}\b|\b(?:{_MONTHS})\s\d{{1,2}},?\s\d{{4}}\b", "0")
    masked = F.regexp_replace(masked, r"\d+(?:[.,:/-]\d+)*", "0")
    cut = F.split(masked, r"\n+|(?<=[.!?…؟।])[\")\]”’»]*\s+|(?<=[。！？])", -1)
    clean = F.transform(cut, lambda m: F.trim(F.regexp_replace(m, r"(?U)\s+", " ")))
    return F.array_distinct(F.filter(clean, lambda m: m.rlike(r"\p{L}")))


def message_kind(message: Column) -> Column:
    """``script``, ``error``, ``filler``, ``helper``, ``title``, or null for what no rule names."""
    words = F.length(message) - F.length(F.replace(message, F.lit(" "), F.lit(""))) + 1
    latin = F.regexp_count(message, F.lit(rf"\b(?:{'|'.join(LOREM.split())})\b"))
    title = (F.length(message) <= TITLE_LENGTH) & (words <= 9) & ~message.rlike(r"[.!?。！？।؟…]$")
    named = F.when(message.rlike(_any(SCRIPTS)), "script").when(message.rlike(_any(ERRORS)), "error").when(message.rlike(_any(FILLERS)), "filler").when(message.rlike(_any(HELPERS)), "helper")
    return F.coalesce(F.when(message.rlike(_CUE) | (message.rlike(r"[^\x00-\x7f]") & message.rlike(_OTHER)), named), F.when((words >= 3) & message.rlike(r"^[a-z .,]+$") & (latin >= words * 0.7), "filler"), F.when(title, "title"))


def message_table(each: DataFrame) -> DataFrame:
    """Every distinct message of (source, message) rows: its hash, the records and sources that hold it, and its kind."""
    by_source = each.groupBy("message", "source").agg(F.count("*").alias("n"))
    grouped = by_source.groupBy("message").agg(F.sum("n").alias("records"), F.count("*").alias("sources"))
    return grouped.select(F.xxhash64("message").alias("hash"), "records", "sources", message_kind(F.col("message")).alias("kind"))


def residue(texts: DataFrame, key: str, source: str, text: str = "text") -> DataFrame:
    """One row (key, reason) for each record to exclude; reason is ``placeholder``, ``script``, ``error`` or ``filler``.

    texts: key (unique), source, text; any of the last two may be null.
    """
    stage = Stage(texts.sparkSession, "residue")
    given = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    each = stage.cut(given.select(F.col(key).alias("key"), F.col(source).alias("source"), F.explode(messages(F.col(text))).alias("message")), "each")
    table = stage.cut(message_table(each), "messages")
    named = table.where("kind is not null").select("hash", "kind")
    count = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    judged = (
        lookup_join(each.select("key", F.xxhash64("message").alias("hash")), named, "hash", salts=SALTS)
        .groupBy("key")
        .agg(count("script").alias("script"), count("error").alias("error"), count("filler").alias("filler"), F.count(F.when(F.col("kind").isNull(), 1)).alias("other"), F.max(F.when(F.col("kind").isNull(), F.col("hash"))).alias("hash"))
        .where("script + error + filler > 0 and other <= 1")
    )
    judged = stage.cut(judged, "judged")
    # a message that stands beside notices wherever it stands, widely, is part of a notice
    beside = judged.where("other = 1").groupBy("hash").agg(F.count("*").alias("n"))
    wide = table.where((F.col("kind").isNull()) & (F.col("records") >= MIN_RECORDS) & (F.col("sources") >= MIN_SOURCES)).select("hash", "records")
    adopted = wide.join(beside, "hash").where("n = records").select("hash")
    whole = judged.where("other = 0").unionByName(judged.where("other = 1").join(adopted, "hash", "left_semi").select(*judged.columns))
    reason = F.when(F.col("script") > 0, "script").when(F.col("error") > 0, "error").otherwise("filler")
    unfilled = given.where(has_placeholder(F.col(text))).select(key, F.lit("placeholder").alias("reason"))
    found = unfilled.unionByName(whole.select(F.col("key").alias(key), reason.alias("reason")))
    return found.groupBy(key).agg(F.min("reason").alias("reason"))


def without_residue(texts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The records that stay, with all their columns."""
    return texts.join(found.select(key), key, "left_anti")
