"""Fixed values.

Everything here has to equal what users of the original study rely on, or has
to be the same on both sides of a check, so it is stated plainly as data.
"""

# The planning-poker scale and its curation limits.
FIBONACCI = [1, 2, 3, 5, 8, 13, 21]
ANSWER_SCALE = [1, 2, 3, 5, 8]
POINT_CAP = 8.0
EXCLUDED_PROJECT = "titanium"
UNKNOWN_LANGUAGE = "unknown"
MISSING_KEY = "SEM_ID"

# Evaluation settings.
FOLDS = 5
SEED = 42
ML_HOLDOUT = 0.2
LM_HOLDOUT = 0.1
MAX_TERMS = 5000
NEIGHBOURS = 5
RETRIEVED = 3
SEQUENCE_LENGTH = 512
MASK_RATE = 0.15
FEW_SHOT_BUDGET = 1024
ZERO_SHOT_BUDGET = 2048

# Strings a CSV reader takes for a missing cell.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Frequent function words per language, in tie-break order.
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "that", "with", "on", "it", "by", "for", "was"],
    "es": ["el", "los", "las", "por", "una", "del", "que", "y", "con"],
    "fr": ["le", "les", "du", "des", "dans", "que", "pour", "par", "un", "une",
           "qui", "et"],
    "de": ["der", "die", "und", "das", "ist", "den", "nicht", "ein", "zu", "mit"],
}

# English stop words dropped from the lemma view.
STOP_WORDS = [
    "a", "about", "above", "across", "after", "again", "against", "all",
    "almost", "along", "already", "also", "although", "always", "am", "among",
    "an", "and", "another", "any", "are", "around", "as", "at", "back", "be",
    "because", "been", "before", "being", "below", "between", "both", "but",
    "by", "can", "cannot", "could", "did", "do", "does", "doing", "done",
    "down", "during", "each", "either", "else", "even", "ever", "every",
    "few", "for", "from", "further", "had", "has", "have", "having", "he",
    "hence", "her", "here", "hers", "herself", "him", "himself", "his", "how",
    "however", "i", "if", "in", "into", "is", "it", "its", "itself", "just",
    "least", "less", "many", "may", "me", "might", "mine", "more", "most",
    "much", "must", "my", "myself", "neither", "never", "no", "nor", "not",
    "now", "of", "off", "often", "on", "once", "only", "onto", "or", "other",
    "our", "ours", "ourselves", "out", "over", "own", "per", "perhaps",
    "please", "quite", "rather", "really", "same", "several", "she", "should",
    "since", "so", "some", "still", "such", "than", "that", "the", "their",
    "theirs", "them", "themselves", "then", "there", "therefore", "these",
    "they", "this", "those", "though", "through", "thus", "to", "together",
    "too", "toward", "under", "until", "up", "upon", "us", "very", "was", "we",
    "well", "were", "what", "when", "where", "whether", "which", "while",
    "who", "whom", "whose", "why", "will", "with", "within", "without",
    "would", "yet", "you", "your", "yours", "yourself", "yourselves",
]

# Irregular forms of the lemma view.
IRREGULAR_LEMMAS = {
    "better": "good", "best": "good", "worse": "bad", "worst": "bad",
    "began": "begin", "broke": "break", "broken": "break", "brought": "bring",
    "built": "build", "came": "come", "children": "child", "chose": "choose",
    "chosen": "choose", "criteria": "criterion", "drawn": "draw", "fell": "fall",
    "felt": "feel", "found": "find", "gave": "give", "given": "give",
    "goes": "go", "gone": "go", "went": "go", "got": "get", "held": "hold",
    "hidden": "hide", "indices": "index", "kept": "keep", "knew": "know",
    "known": "know", "left": "leave", "lost": "lose", "made": "make",
    "meant": "mean", "men": "man", "people": "person", "ran": "run",
    "said": "say", "saw": "see", "seen": "see", "sent": "send",
    "shown": "show", "taken": "take", "taught": "teach", "thought": "think",
    "told": "tell", "took": "take", "understood": "understand", "women": "woman",
    "wrote": "write", "written": "write",
}

# Suffix rules of the lemma view as (suffix, pattern, what follows
# the kept group).
# They are applied one after the other to each token.
SUFFIX_RULES = [
    ("ies", r"^([a-z0-9_]{2,})ies$", "y"),
    ("es", r"^([a-z0-9_]+(?:s|x|z|ch|sh))es$", ""),
    ("s", r"^([a-z0-9_]*[a-z0-9_][^su0-9_])s$", ""),
    ("ing", r"^([a-z0-9_]*[aeiouy][a-z0-9_]+)ing$", ""),
    ("ed", r"^([a-z0-9_]*[aeiouy][a-z0-9_]+)ed$", ""),
]

# Prompt texts. The study's participants see them verbatim.
TEMPLATE_SLOT = "{requirement_description}"
ZERO_SHOT_TEMPLATE = (
    "Act as a senior software engineer responsible for estimating the effort "
    "required to complete tasks based on their descriptions.\n"
    "Your task is to assign a story point value to the DESCRIPTION provided "
    "below.\n"
    "Use story points as a relative estimation metric, as adopted in agile "
    "methodologies. This metric accounts for effort, complexity, and risk, and "
    "should not be directly tied to time.\n"
    "Use the following Fibonacci-based values for your estimates:\n"
    "    1 – very simple task\n"
    "    2 or 3 – simple or moderately complex task\n"
    "    5 – complex task\n"
    "    8 – high-effort or high-uncertainty task\n"
    "⚠️ IMPORTANT: Respond with only one number — 1, 2, 3, 5, or 8. Do "
    "not include any explanations, reasoning, or additional text.\n"
    "###DESCRIPTION\n"
    "{requirement_description}\n"
    "###OUTPUT"
)
INSTRUCTIONS = (
    "Você é um engenheiro de software sênior responsável por estimar o esforço "
    "necessário para concluir tarefas, com base em suas descrições. Utilize a "
    "métrica de story points, que representa o esforço relativo.\n\n"
    "Os valores válidos são baseados na sequência de Fibonacci: 1, 2, 3, 5 e 8.\n"
    "- 1: tarefa muito simples\n"
    "- 2 ou 3: tarefa simples ou moderada\n"
    "- 5: tarefa complexa\n"
    "- 8: tarefa de alto esforço\n\n"
    "IMPORTANTE:\n"
    "- Responda com apenas um número: 1, 2, 3, 5 ou 8\n"
    "- Não adicione frases ou símbolos\n"
    "- A resposta deve vir após o marcador ###\n"
)
WORKED_EXAMPLES = (
    "\nExemplos:\n"
    "Descrição da tarefa:\nAdicionar autenticação com OAuth2.\n###\n5\n\n"
    "Descrição da tarefa:\nCorrigir erro de digitação em mensagem de "
    "boas-vindas.\n###\n1\n\n"
)
TASK_HEADER = "Descrição da tarefa:\n"
ANSWER_MARK = "###"
