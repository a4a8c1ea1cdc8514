"""Labels, catalogues and word lists that results depend on."""

from __future__ import annotations

# --- fixed values: report types and labels ------------------------------------
REPORT_TYPES = ("drilling", "completion", "workover", "move")
REPORT_TYPE_LABELS = {"drilling": "钻井", "completion": "完井", "workover": "修井", "move": "搬迁/推井架"}
LANGUAGE_LABELS = {"zh-CN": "Simplified Chinese", "en": "English", "es": "Spanish"}
UNKNOWN_RIG = "未识别井队"
UNKNOWN_LABEL = "未识别"
NO_CATEGORY = "未填写 OP CODE / OP SUB"
STATUS_WARNING = "有告警"
STATUS_NORMAL = "正常"
UNASSIGNED_ID = "__unassigned__"
UNASSIGNED_NAME = "未归属项目"
IDENTITY_LABELS = (("reportDate", "日报日期"), ("wellbore", "井号"), ("rig", "井队"))

# --- fixed values: rig names that never count ---------------------------------
INVALID_RIG_NAMES = ("UNKNOWN", "N/A", "NA", "NONE", "NULL", "-", "--")
INVALID_RIG_MARKER = "PLACEHOLDER"

# --- fixed values: required header fields per report type -----------------------
_REQUIRED_COMMON = ("event", "reportDate", "reportNo", "wellbore", "rig")
_REQUIRED_TEXT = ("currentOps", "summary24h", "forecast24h")
REQUIRED_FIELDS = {
    "drilling": (*_REQUIRED_COMMON, "todayMd", "progress", *_REQUIRED_TEXT, "mudType", "mudDensity"),
    "completion": (*_REQUIRED_COMMON, *_REQUIRED_TEXT),
    "workover": (*_REQUIRED_COMMON, *_REQUIRED_TEXT),
    "move": (*_REQUIRED_COMMON, *_REQUIRED_TEXT),
}

# --- fixed values: units a number may carry without being "corrected" -----------
NUMBER_UNITS = (
    "ft", "feet", "in", "inch", "ppg", "psi", "gpm", "usd", "h", "hr", "hrs", "deg", "bbl", "spf", "lb", "lbs",
)

# --- fixed values: fields that hold prose, in reading order ----------------------
TEXT_REPORT_FIELDS = (
    "currentOps", "summary24h", "forecast24h", "description",
    "mudComments", "incidentComments", "safetyComments", "otherRemarks",
)
TEXT_ROW_FIELDS = ("operation_details", "comments")

# --- fixed values: term dictionary classes ---------------------------------------
TERM_CATEGORIES = ("general", "drilling", "completion", "workover", "move")
TERM_CATEGORY_ALIASES = {
    "operation": "drilling", "event": "drilling", "drilling_metric": "drilling", "well_depth": "drilling",
    "equipment": "drilling", "mud": "drilling",
    "通用": "general", "钻井": "drilling", "完井": "completion", "修井": "workover", "搬迁": "move",
}
TERM_TYPES = ("protected", "preferred", "contextual", "phrase")
TERM_TYPE_ALIASES = {
    "严格保护词": "protected", "严格保护": "protected",
    "固定标准术语": "preferred", "标准术语": "preferred",
    "上下文术语": "contextual", "行业短语": "phrase",
}

# --- fixed values: Spanish marks and words --------------------------------------
SPANISH_MARKS = "ÁÉÍÓÚÜÑáéíóúüñ¿¡"
LATIN_CLASS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
SPANISH_WORDS = (
    "con", "para", "desde", "hasta", "perfora", "saca", "bombea", "circula", "pozo", "broca", "revestimiento",
    "herramienta", "incidentes?", "sin", "reportar", "ultimas?", "traslado", "fluidos?", "campamentos?", "personal",
    "ingresa", "servicio", "aguas?", "cortes", "perforacion", "venta", "provisto", "cerrada", "realiza", "prueba",
    "presion", "como", "sigue", "izquierda", "mecanico", "completacion",
)

# --- fixed values: month names (Spanish and English) ------------------------------
MONTHS = {
    1: ("enero", "january", "jan"), 2: ("febrero", "february", "feb"), 3: ("marzo", "march", "mar"),
    4: ("abril", "april", "apr"), 5: ("mayo", "may"), 6: ("junio", "june", "jun"), 7: ("julio", "july", "jul"),
    8: ("agosto", "august", "aug"), 9: ("septiembre", "setiembre", "september", "sep", "sept"),
    10: ("octubre", "october", "oct"), 11: ("noviembre", "november", "nov"), 12: ("diciembre", "december", "dec"),
}

# --- fixed values: action concepts, source pattern and target pattern --------------
ACTION_CONCEPTS = (
    ("drill", r"\b(?:perfor(?:a|ó|ando|ar)|drill(?:ed|ing)?)\b", "钻进|钻至|开钻"),
    ("pump", r"\b(?:bombe(?:a|ó|ando|ar)|pump(?:ed|ing)?)\b", "泵入|泵送|注入"),
    ("circulate", r"\b(?:circul(?:a|ó|ando|ar)|circulat(?:e|ed|ing))\b", "循环"),
    ("trip_out", r"\b(?:saca|sacando|sacar|trip(?:ping)?\s+out|pull(?:ed|ing)?)\b", "起出|起钻|上提"),
    ("trip_in", r"\b(?:baja|bajando|bajar|trip(?:ping)?\s+in|run(?:ning)?\s+in)\b", "下入|下钻|下放"),
    ("change", r"\b(?:cambia|cambió|cambio|cambiar|chang(?:e|ed|ing))\b", "更换|换用|替换"),
    ("test", r"\b(?:prueba|probar|test(?:ed|ing)?)\b", "试验|测试|检验"),
)

# --- fixed values: unicode fractions and glued verbs seen in scanned text ------------
UNICODE_FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
OCR_VERBS = ("INGRESAN", "INGRESA", "FILTRA", "PERFORA", "BOMBEA", "CIRCULA", "DESPLAZA", "RECUPERA", "BAJA", "SACA")

# --- fixed values: page furniture dropped from report prose (the operator's own name
# --- line is passed by the caller) ----------------------------------------------------
PAGE_FURNITURE = (r"page\s+\d+\s+of\s+\d+", r"daily\s+operations\s+report")

# --- fixed values: operation-code prefixes per report layout ---------------------------
OP_CODE_PREFIXES = {
    "drilling": (
        ("DRILLI", "DRILLING"), ("CIRCU", "CIRCULATING"), ("CASI", "CASING"),
        ("RIG", "RIG MAINTENANCE"), ("WELL", "WELLHEAD"), ("BHA", "BHA"),
    ),
    "completion": (
        ("PERFORAT", "PERFORATING"), ("STIMULATI", "STIMULATION"), ("SURFACEEQUIPMEN", "SURFACE EQUIPMENT"),
        ("SLICKLINE", "SLICK LINE"), ("SAFETY", "SAFETY"), ("LOGGING", "LOGGING"),
    ),
    "workover": (
        ("WELLHEAD", "WELLHEAD"), ("COMPLETI", "COMPLETION OPS"), ("SURFACEEQUIPMEN", "SURFACE EQUIPMENT"),
        ("WELLCONTROL", "WELL CONTROL"), ("SLICKLINE", "SLICK LINE"), ("BOPTEST", "BOP TEST"),
        ("MOVE", "MOVE"), ("TESTING", "TESTING"),
    ),
    "move": (("MOVE", "MOVE"),),
}

# --- fixed values: responsible-party wording ---------------------------------------------
PARTY_PATTERNS = (
    r"\bNPT\s+A\s+CARGO\s+DE\s+([A-Z][A-Z0-9&._ -]{1,50})",
    r"\b(?:RESPONSABLE|RESPONSABILIDAD\s+DE)\s*[:=-]?\s*([A-Z][A-Z0-9&._ -]{1,50})",
    r"\b(?:RESPONSIBLE\s+(?:PARTY|COMPANY)|ACCOUNTABLE\s+TO)\s*[:=-]?\s*([A-Z][A-Z0-9&._ -]{1,50})",
)
PARTY_STOP = r"[;,]|\b(?:DURING|FOR|FROM|WITH|POR|PARA|DESDE|CON)\b"
PARTY_CAUSE = r"FALL[AO]|FALLA|FAIL(?:URE|ED)?|FAULT|ANOMAL|P[ÉE]RDIDA|LOSS|CA[IÍ]DA|DEFECT|DA[ÑN]O|WASHOUT"
PARTY_PREFIX = r"^(?:RESPONSIBLE\s+(?:PARTY|COMPANY)|SERVICE\s+LINE|RESPONSABLE)\s*[:=-]?\s*"
PARTY_NULLS = ("NULL", "NONE", "N/A", "UNKNOWN", "NO IDENTIFICADO", "无法确定", "空字符串")

# --- fixed values: error wording of transient faults -----------------------------------------
TRANSIENT_ERROR = (
    r"timeout|timed out|connection|remote end closed|temporar|rate limit|429|502|503|504|网络|超时|连接"
)

# --- fixed values: spreadsheet headers of an imported term list ---------------------------------
TERM_HEADERS = {
    "category": ("作业类型", "分类", "category", "operationtype", "reporttype"),
    "term_type": ("术语类型", "类型", "termtype", "glossarytype"),
    "zh": ("中文", "中文术语", "chinese", "zh", "cn"),
    "en": ("英文", "英文术语", "english", "en"),
    "es": ("西班牙语", "西语", "español", "spanish", "es"),
    "aliases_zh": ("中文别名", "zhaliases", "chinesealiases"),
    "aliases_en": ("英文别名", "enaliases", "englishaliases"),
    "aliases_es": ("西语别名", "西班牙语别名", "esaliases", "spanishaliases"),
    "priority": ("优先级", "priority", "rank"),
    "strict_preserve": ("严格原样保留", "严格保护", "strictpreserve", "keepexact"),
    "protected": ("锁定译法", "锁定", "protected", "locked"),
    "enabled": ("启用", "enabled", "status"),
}

# --- fixed values: job states ----------------------------------------------------------------------
QUEUE_DONE = ("QUEUED", "IN_PROGRESS", "NOT_REQUIRED")
QUEUE_RETRY = ("PENDING", "STOPPED", "FAILED")
QUEUE_REASONS = {
    "STOPPED": "已停止，可继续未完成翻译",
    "QUEUED": "等待执行",
    "IN_PROGRESS": "模型翻译中",
    "FAILED": "上次翻译失败",
    "STALE": "翻译策略已更新",
    "COMPLETED": "已完成",
    "PENDING": "尚未翻译",
}
