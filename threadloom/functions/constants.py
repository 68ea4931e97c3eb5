"""Fixed values.

Results depend on these exact words, patterns, orders and numbers, so they are stated as they are.
"""

# English stop words that can still occur once punctuation is gone.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "couldn", "didn", "doesn", "hadn", "hasn",
    "haven", "isn", "ma", "mightn", "mustn", "needn", "shan", "shouldn", "wasn", "weren", "won", "wouldn",
]

# Literal replacements, applied in this order.
SEARCH_REPLACEMENTS = (
    ("π", "pi"),
    ("#39;", "'"),
    ("amp;", "&"),
    ("#146;", "'"),
    ("nbsp;", " "),
    ("#36;", "$"),
    ("\\n", "\n"),
    ("quot;", "'"),
    ("<br />", "\n"),
    ('\\"', ""),
    ("<unk>", "u_n"),
    (" @.@ ", "."),
    (" @-@ ", "-"),
    ("\\", " \\ "),
    ('"', "'"),
    ("\n", " "),
    ("\r", " "),
)

# Patterns of the search form.
SPACED_PUNCTUATION = r"[/(){}\[\]\|@,;]"
DELETED_SYMBOLS = r"[^0-9a-z #+_]"
OTHER_THAN_ALPHANUMERIC = r"[^A-Za-z0-9]"

# Patterns of the mark-up remover.
CODE_BLOCK = r"<code>[^>]*</code>"
ANY_TAG = r"<[^>]*>"

# Whitespace as an explicit class, equal in every regex dialect used.
SPACE_CLASS = r"[ \t\n\r\f\x0B\x{85}\x{a0}]"

# Marker words of the encoded corpus and the vocabulary specials.
BEGIN_MARK = "xbos"
FIELD_MARK = "xfld"
SHORT_SPECIALS = ("_unk_", "_pad_")
LONG_SPECIALS = ("_unk_", "_pad_", "_bos_", "_eos_")

# The tags of the topic subset.
TOPIC_TAGS = [
    "python", "django", "python-3.x", "python3x", "pythonx", "python-2.7", "python27", "apache-spark",
    "apachespark", "pandas", "numpy", "matplotlib", "flask", "tensorflow", "machine-learning",
    "machinelearning", "nlp", "cuda", "neural-network", "neuralnetwork", "artificial-intelligence",
    "artificialintelligence", "deep-learning", "deeplearning",
]

# Canonical tag <- raw tags, as they look after label cleaning without and with digits.
TAG_GROUPS = {
    "c++c": ["c++", "c", "objectivec", "visualc++", "cmake", "qt"],
    "java": ["java", "eclipse"],
    "php": ["php", "laravel", "symfony", "magento", "drupal"],
    "ruby": ["ruby", "rubyonrails", "rubyonrails3"],
    "sql": [
        "sql", "sqlserver", "mysql", "mongodb", "database", "postgresql", "sqlite", "cassandra",
        "sparql", "plsql", "couchdb", "hbase", "hive", "sqlserver2008",
    ],
    "python": [
        "python", "django", "pythonx", "apachespark", "pandas", "numpy", "matplotlib", "flask",
        "heroku", "python3x", "python27",
    ],
    "javascript": [
        "javascript", "json", "jquery", "angularjs", "angular", "jquerymobile", "reactjs", "ajax",
        "npm", "nodejs", "vuejs", "knockoutjs", "djs", "emberjs", "reactnative", "clojure", "d",
        "extjs", "d3js",
    ],
    "ios": ["ios", "iphone", "swift", "swift3", "ios7", "ios5", "ios4"],
    ".net": ["net", "aspnet", "aspnetmvc", "vbnet", "aspnetmvc3"],
    "bash": ["git", "bash", "powershell", "shell", "vim", "versioncontrol", "ssh"],
    "excel": ["excelformula", "excel", "excelvba"],
    "basic": ["html", "css", "xml", "http", "curl", "html5", "css3"],
    "os": ["macos", "windows", "linux", "ubuntu", "email", "internetexplorer", "googlechrome"],
    "frameworks": [
        "sharepoint", "vba", "wpf", "entityframework", "wordpress", "oracle", "facebook", "azure",
        "amazonwebservices", "visualstudio", "docker", "elasticsearch", "googleappengine", "aws",
        "visualstudiocode", "androidstudio", "amazonec", "amazons", "tableau", "visualstudio2010",
    ],
    "machine_learning": [
        "tensorflow", "machinelearning", "algorithms", "hadoop", "validation", "nlp", "cuda",
        "neuralnetwork", "artificialintelligence", "vector", "deeplearning", "algorithm", "math",
    ],
    "list": ["list", "arrays"],
    "actionscript3-flex-flash": ["actionscript", "flex", "flash", "googleappsscript"],
    "apache": ["apache", "maven", "grails", "cordova", "htaccess"],
}

# Weights of the final linear combination; the tag score weighs 1.
RERANK_WEIGHTS = {"distance": 0.92, "tfidf": 0.74, "ngram": 0.21, "combo": 0.33}

# Search and model settings.
TOP_NEIGHBOURS = 10
TOP_TAGS = 3
CONFIDENCE_CUTOFF = 0.8
PCA_COMPONENTS = 50
MAX_DOC_SHARE = 0.9
INVERSE_REGULARISATION = 4.0
EVALUATION_DEPTHS = (1, 5, 10, 100, 500, 1000)
BOOSTED_TREES = 300
BOOSTED_DEPTH = 7
BOOSTED_STEP = 0.1
BOOSTED_SAMPLE = 0.8
NETWORK_LAYERS = (128, 256, 128)
NETWORK_ITERATIONS = 50

# Common named entities unescaped without leaving the JVM; "&amp;" must come last.
NAMED_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&hellip;", "…"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&amp;", "&"),
)
