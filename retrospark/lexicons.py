"""Word lists and settings that results depend on, as data."""

from __future__ import annotations

# Abbreviations and what they stand for.
ABBREVIATIONS: dict[str, list[str]] = {
    "vc": ["você"], "vcs": ["vocês"], "cê": ["você"], "cmg": ["comigo"],
    "nao": ["não"], "ñ": ["não"],
    "pq": ["porque", "por que"], "qdo": ["quando"], "qnd": ["quando"], "qto": ["quanto"], "tbm": ["também"], "tb": ["também"], "tmb": ["também"], "msm": ["mesmo"],
    "mt": ["muito"], "mto": ["muito"], "muinto": ["muito"],
    "hj": ["hoje"], "dps": ["depois"], "agr": ["agora"], "amanha": ["amanhã"],
    "obg": ["obrigado", "obrigada"], "pfv": ["por favor"], "pfvr": ["por favor"], "vlw": ["valeu"], "flw": ["falou"],
    "blz": ["beleza"], "ctz": ["certeza"], "clr": ["claro"],
    "kd": ["cadê", "onde"], "td": ["tudo"], "nda": ["nada"],
    "repo": ["repositório", "repository"], "deps": ["dependências", "dependencies"], "env": ["ambiente", "environment"], "db": ["banco de dados", "database"], "msg": ["mensagem", "message"], "msgs": ["mensagens", "messages"],
}

# Words that make a query descriptive.
STOP_WORDS = [
    "como", "por", "que", "porque", "quando", "onde", "qual", "quais", "quem", "se", "mas", "nem", "pois", "logo", "então",
    "de", "da", "do", "em", "para", "com", "sem", "sobre", "entre", "no", "na", "nos", "nas", "ao", "aos", "às", "pelo", "pela",
    "um", "uma", "uns", "umas", "o", "a", "os", "as",
    "foi", "usar", "usamos", "decidimos", "escolhemos", "queremos", "temos", "fazer", "faz", "está", "estamos", "não", "nao",
    "how", "why", "when", "what", "where", "who", "which", "the", "is", "are", "was", "we", "did", "not", "with", "for", "about", "from", "to", "in", "on", "at",
]

# Markers of blocks worth indexing.
SELECTIVE_MARKERS = [
    "decidimos", "decisao", "decisão", "adr", "trade-off", "tradeoff", "escolhemos", "optamos", "vs", "ao invés de",
    "descartamos", "abandonamos", "não funciona", "nao funciona", "não funcionou", "nao funcionou", "tentei", "tentamos", "não resolveu", "nao resolveu", "falhou", "revertemos",
    "decidimos não", "decidimos nao", "o problema não era", "o problema nao era", "na verdade", "descobrimos que", "afinal",
    "o usuário quer", "o usuario quer", "o usuário pediu", "o usuario pediu",
    "preciso", "o plano é", "a estratégia", "arquitetura", "architecture",
    "o problema é", "o bug", "a causa", "root cause",
    "schema", "create table", "migração", "migracao", "custo zero", "latência local", "on-premise",
]

# Markers of decisions, which don't age.
DECISION_MARKERS = [
    "decidimos", "decisao", "decisão", "adr", "trade-off", "tradeoff", "escolhemos", "optamos", "vs", "instead of", "ao invés de",
    "porque não usar", "porque nao usar", "arquitetura", "architecture", "schema", "migração", "migracao",
]

# Weights by role (others 1.0), and the labels of an exchange's two sides.
ROLE_WEIGHTS = {"exchange": 1.0, "user": 1.0, "assistant": 1.0, "thinking": 0.6, "tool_context": 0.7}
USER_LABEL, ASSISTANT_LABEL = "Usuário", "Claude"
