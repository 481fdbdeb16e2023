"""Fixed values the results depend on.

Everything here is data: patterns, messages, word lists and thresholds. The rules that use
them live in the operators. Regular expressions carry no flags; `regex()` adds them.
"""

# --- fixed values: billing columns (source header -> canonical name) -----------------
COLUMN_ALIASES = {
    "ano": "year",
    "mês": "month",
    "nmcliente": "client",
    "nmcolaborador": "collaborator",
    "vlrfaturamento": "amount",
    "categoria": "category",
}
FACT_COLUMNS = ["year", "month", "client", "collaborator", "amount"]

# --- fixed values: every character with the Unicode property White_Space ------------------
BLANKS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: areas ---------------------------------------------------------------
AREAS = ["financeiro", "operacional", "estrategico"]

# --- fixed values: mention patterns ------------------------------------------------------
YEAR_PATTERN = r"\b(202[0-9])\b"
ENTITY_PATTERNS = [
    r"cliente\s+([^,\.]+)",
    r"empresa\s+([^,\.]+)",
    r"(?:para|de)\s+([A-Z][A-Za-z\s]{3,})\s+(?:aumentou|recebemos|contratamos)",
]
# Pieces of which a text must hold one, in lower case, before the third pattern can match.
# They leave out the letters that other characters fold to.
ENTITY_PATTERN_3_PIECES = ["aumentou", "recebemo", "contratamo"]
ENTITY_STOP_WORDS = ["qual", "este", "seria"]
ENTITY_MIN_LENGTH = 3

# --- fixed values: phrase rules (pattern, description) -----------------------------------
PHRASE_RULES = [
    (r"em\s+2024\s+(?:tínhamos|foi|era)", "referência a 2024 que não existe nos dados"),
    (r"(?:crescimento|aumento)\s+(?:nos\s+últimos\s+)?3\s+anos", "menção a 3 anos quando só há 2"),
    (
        r"(?:historicamente|no\s+passado)\s+[^.]*(?:2020|2021|2022|2023)",
        "referência a anos históricos não presentes",
    ),
    (r"com\s+base\s+(?:na\s+)?experiência(?!\s+própria)", "análise externa sem base em dados"),
]

# Piece a text must hold, in lower case, before the rule of the same place can match.
PHRASE_PIECES = ["2024", "3", "202", "exper"]

# --- fixed values: false-positive patterns over generated warnings -----------------------
FALSE_POSITIVE_PATTERNS = [
    r"Cliente/Empresa '([^']+)' não encontrado.*(?:fez|teve|contribuiu)",
    r"Cliente/Empresa '.*(?:contribuiu|cresceu|diminuiu|variou).*' não encontrado",
    r"Cliente/Empresa '(?:é|foi|foi|está|tem|possui|tem|apresenta).*não encontrado",
]

# --- fixed values: required report headings ----------------------------------------------
REPORT_HEADINGS = [
    ("#", "🧭", "Plano Executivo de Dashboard"),
    ("##", "🎯", "Objetivo do Dashboard"),
    ("##", "🧠", "Leitura Executiva"),
    ("##", "📈", "KPIs Prioritários"),
    ("##", "📊", "Visualizações Recomendadas"),
    ("##", "🧠", "Insights Refinados e Priorizados"),
    ("##", "⚠️", "Pontos de Atenção"),
    ("##", "🛠️", "Estrutura Técnica do Dashboard"),
    ("##", "🚀", "Roadmap de Implementação"),
    ("##", "📌", "Recomendações Executivas"),
]

# --- fixed values: model errors -----------------------------------------------------------
MODEL_ERROR_PREFIXES = ["[!]"]
# What the model client itself puts before its errors; a wider list that callers may choose.
MODEL_ERROR_PREFIXES_WIDE = ["[!]", "❌"]
MODEL_ERROR_NULL = "resposta None"
MODEL_ERROR_PREFIX = "resposta inválida ou prefixo [!]"

# --- fixed values: payload -----------------------------------------------------------------
PAYLOAD_SCHEMA_VERSION = "1.1"
LOG_SCHEMA_VERSION = "1.0"
CHECK_FIELDS = [
    "anos_e_periodos_usados_estao_nos_dados",
    "numeros_citados_sao_verificaveis_nos_agregados",
]
EMPTY_CONTENT = "conteudo_estruturado_vazio"
JSON_ERRORS = {
    "empty": "texto vazio ou inválido",
    "not_object": "JSON carregado mas não é um objeto (dict)",
    "no_delimiter": "não foi possível localizar delimitadores de JSON",
    "not_found": "não foi possível localizar/parsear um objeto JSON válido",
    # Kept for completeness of the message set: a candidate starts with a brace, so it is an
    # object whenever it parses, and this message cannot occur.
    "candidate_not_object": "JSON extraído mas não é um objeto (dict)",
    # Our own: JSON that is beyond the size of a variant.
    "too_large": "JSON grande demais para ser lido",
}

# --- fixed values: outputs -------------------------------------------------------------------
EMPTY_MARKDOWN = "[!] Nenhum conteudo gerado"
PREVIEW_LENGTH = 500
REPORT_LENGTH = 2000
REPORT_CUT_NOTE = "[Analise completa disponivel em 'dashboard.md']"
STRIPPED_CHARACTERS = "<>&#*"
LOG_HEAD_LENGTH = 100

# --- fixed values: warning classes and suggestions --------------------------------------------
CLASS_CLIENT = "cliente_invalido_falso_positivo"
CLASS_REFERENCE = "referencia_invalida"
CLASS_YEAR = "ano_invalido"
CLASS_OTHER = "outro"
CLASS_YEARS = ["2024", "2027"]
# (name, threshold that must be exceeded, text)
SUGGESTIONS = [
    (
        "client",
        3,
        "Melhoria 1: O regex de detecção de cliente está muito agressivo. "
        "Deve validar apenas NOMES de clientes, não menções em contexto.",
    ),
    (
        "reference",
        2,
        "Melhoria 2: O prompt deve ser mais específico sobre que tipo de "
        "referência é válida. Adicione exemplos de referências VÁLIDAS.",
    ),
    (
        "total",
        5,
        "Melhoria 3: Adicione seção 'EXEMPLOS DE ANÁLISE VÁLIDA' no prompt "
        "mostrando como analisar os dados sem inventar.",
    ),
]

# --- fixed values: insight labels ---------------------------------------------------------------
CONFIDENCE_ORDER = ["alta", "moderada", "baixa"]
RISK_ORDER = ["Alto", "Moderado", "Baixo"]
RISK_HIGH = (30.0, 50.0)  # top-1 share, amplitude: above either is high risk
RISK_MODERATE = (15.0, 25.0)  # our choice, the source gives no lower bound
LOAD_OVER, LOAD_UNDER = 1.5, 0.5  # our choice
COVERAGE_TARGET = 0.8  # our choice
CITED_TOLERANCE = 0.005  # our choice


def regex(pattern: str, flags: str = "iUd") -> str:
    """Inline the flags: U brings Unicode case folding, word borders and blanks; with d
    only a line feed ends a line."""
    return f"(?{flags}){pattern}"

# --- fixed values: wordings around prompts and report texts -------------------------------
INSIGHTS_MARKER = "{insights}"
DATA_MARKER = "{dados}"
CONTRACT_REMINDER = (
    "\n\n=== CONTRATO DE SAIDA (OBRIGATORIO) ===\n"
    "- Responda APENAS com JSON válido.\n"
    "- Não inclua texto antes/depois, nem Markdown ou codefence.\n"
    "- O JSON DEVE ser um objeto (dict) e seguir o esquema descrito.\n"
)
REPORT_RETRY = (
    "\n\n---\n"
    "ATENCAO: A resposta anterior NAO seguiu o formato requerido. "
    "Reescreva SOMENTE com Markdown e seguindo exatamente todas as seções obrigatórias do início do template."
    "\n\n---\n"
    "Resposta anterior (para referência):\n"
)
REPORT_MISSING = "❌ Gerente não retornou conteúdo"
REPORT_BAD_FORMAT = "❌ Gerente retornou conteúdo, mas o formato ficou fora do padrão.\n\n"
