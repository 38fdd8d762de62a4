"""Lists, tables and patterns whose content decides the results."""

# Fixed values. A paper is dropped when any of these occurs in its title or abstract.
OFF_TOPIC_WORDS = [
    "galaxy", "galaxies", "dark matter",
    "dark energy", "quasar", "black hole",
    "cosmology", "Black Hole", "Cosmology",
    "Galaxy", "Globular", "globular", "cluster",
    "Cluster", "Quasar", "Dark Energy", "cosmological",
    "NGC", "Herbig", "Galaxies", "White Dwarf", "white dwarf",
    "cosmic", "microwave", "Microwave", "Dark energy",
    "neurtrino", "Neutrino", "Quark", "quark", "Milky Way",
    "Galactic", "Open Cluster", "Open cluster", "Cosmological",
    "Baryon", "baryon", "Subdwarfs", "subdwarfs",
    "Type II", "Type I", "type II", "type I", "coronal mass",
    "Prominence", "Prominences", "Coronal mass", "Boyajian",
    "interstellar medium", "IGM", "ISM", "href", "url", "Redshifts",
    "21-cm", "21 cm", "Relativity", "Relativistic", "SuperNova", "super nova",
    "Super Nova", "pulsar", "Pulsar", "open clusters",
]
PROFILE_OFF_TOPIC_WORDS = OFF_TOPIC_WORDS + ["Ga"]
BODY_OFF_TOPIC_WORDS = OFF_TOPIC_WORDS + ["pulsation"]

# Fixed values. Title words containing any of these are left out of the word statistics.
TITLE_NOISE = ["SUP", "using", "Using", "II", "III", "IV", "SUB", "New", "new", "first", "First"]

# Fixed values. Journals with a section rule for their full text.
SCIENCE = "Science"
APJ = "The Astrophysical Journal"
MNRAS = "Monthly Notices of the Royal Astronomical Society"
JOURNALS = [SCIENCE, APJ, MNRAS]

# Fixed values. Category codes kept at ingest and the names stored for them.
CATEGORY_NAMES = {
    "astro-ph": "Astrophysics",
    "astro-ph.EP": "Earth and Planetary Astrophysics",
    "astro-ph.IM": "Instrumentation and Methods for Astrophysics",
    "astro-ph.SR": "Solar and Stellar Astrophysics",
    "cs.AI": "Artificial Intelligence",
    "cs.CG": "Computational Geometry",
    "cs.CL": "Computation and Language",
    "cs.CV": "Computer Vision and Pattern Recognition",
    "cs.DL": "Digital Libraries",
    "cs.DM": "Discrete Mathematics",
    "cs.DS": "Data Structures and Algorithms",
    "cs.ET": "Emerging Technologies",
    "cs.FL": "Formal Languages and Automata Theory",
    "cs.GL": "General Literature",
    "cs.GR": "Graphics",
    "cs.IR": "Information Retrieval",
    "cs.IT": "Information Theory",
    "cs.LG": "Machine Learning",
    "cs.LO": "Logic in Computer Science",
    "cs.MA": "Multiagent Systems",
    "cs.MS": "Mathematical Software",
    "cs.NA": "Numerical Analysis",
    "cs.NE": "Neural and Evolutionary Computing",
    "cs.NI": "Networking and Internet Architecture",
    "cs.PL": "Programming Languages",
    "cs.SC": "Symbolic Computation",
    "cs.SE": "Software Engineering",
    "eess.IV": "Image and Video Processing",
    "eess.SP": "Signal Processing",
    "math.AP": "Analysis of PDEs",
    "math.MP": "Mathematical Physics",
    "math.NA": "Numerical Analysis",
    "math.ST": "Statistics Theory",
    "math-ph": "Mathematical Physics",
    "physics.ao-ph": "Atmospheric and Oceanic Physics",
    "physics.app-ph": "Applied Physics",
    "physics.atm-clus": "Atomic and Molecular Clusters",
    "physics.atom-ph": "Atomic Physics",
    "physics.bio-ph": "Biological Physics",
    "physics.chem-ph": "Chemical Physics",
    "physics.class-ph": "Classical Physics",
    "physics.comp-ph": "Computational Physics",
    "physics.data-an": "Data Analysis, Statistics and Probability",
    "physics.ed-ph": "Physics Education",
    "physics.flu-dyn": "Fluid Dynamics",
    "physics.gen-ph": "General Physics",
    "physics.geo-ph": "Geophysics",
    "physics.hist-ph": "History and Philosophy of Physics",
    "physics.ins-det": "Instrumentation and Detectors",
    "physics.med-ph": "Medical Physics",
    "physics.optics": "Optics",
    "physics.plasm-ph": "Plasma Physics",
    "physics.pop-ph": "Popular Physics",
    "physics.soc-ph": "Physics and Society",
    "physics.space-ph": "Space Physics",
    "q-bio.BM": "Biomolecules",
    "q-bio.CB": "Cell Behavior",
    "q-bio.GN": "Genomics",
    "q-bio.MN": "Molecular Networks",
    "q-bio.NC": "Neurons and Cognition",
    "q-bio.OT": "Other Quantitative Biology",
    "q-bio.PE": "Populations and Evolution",
    "q-bio.QM": "Quantitative Methods",
    "q-bio.SC": "Subcellular Processes",
    "q-bio.TO": "Tissues and Organs",
    "quant-ph": "Quantum Physics",
    "stat.AP": "Applications",
    "stat.CO": "Computation",
    "stat.ME": "Methodology",
    "stat.ML": "Machine Learning",
    "stat.OT": "Other Statistics",
    "stat.TH": "Statistics Theory",
}

# Fixed values. Markup replaced in corpus samples, applied in this order.
MARKUP_RULES = [
    ("~", "about "),
    ("<SUB>", "_"),
    ("</SUB>", ""),
    ("<SUP>", "^"),
    ("</SUP>", ""),
    ("<BR /> ", ""),
    (" <P />", ""),
    (" <A />", ""),
    ("{", ""),
    ("}", ""),
    ("\t", " "),
    ("\r", " "),
]

# Fixed values. Byte sequences replaced in corpus samples, in this order.
BYTE_RULES = [
    (b'\xef\xac\x81', "fi"),
    (b'\xef\xac\x83', "fi"),
    (b'\xe2\x80\x99', "'"),
    (b'\xef\xac\x80', "ff"),
    (b'\xe2\x88\xbc', "~"),
    (b'\xce\xbcm', "micron"),
    (b'\xce\xbc m', "micron"),
    (b'\xc2\xb5m', "micron"),
    (b'\xc2\xa9', ""),
    (b'\xcb\x87', ""),
    (b'\xe2\x88\x92', "-"),
    (b'\xef\xac\x82', "fl"),
    (b'\xce\xb1', "-alpha-"),
    (b'\xc3\x97', "~"),
    (b'\xe2\x8a\x99', "_sun"),
    (b'\xe2\x80\x93', "-"),
    (b'\xa0', " "),
    (b'\xe2\x80', ""),
    (b'\x9c', "'"),
    (b'\x9d', "'"),
    (b'\x94', ""),
    (b'\x98', "'"),
    (b'\xb2', ""),
    (b'\xc2\xb1 ', "+-"),
    (b'\xce', ""),
    (b'\xb7', ""),
    (b'\xc2\xa7', "Section"),
    (b'\xe2\x88', ""),
    (b'\x97', ""),
    (b'\xbb', ""),
    (b'\t', ""),
    (b'     ', " "),
]

# Fixed values. Section headings after which a corpus sample starts, tried in this order.
SECTION_MARKERS = ["ABSTRACT", "Abstract", "INTRODUCTION"]

# Fixed values. Markers around the main section of an article, by journal.
REFERENCES = "References"
SCIENCE_START = "\n\n1\n\n"
SCIENCE_NUMBERS = [(f"\n{i}\n\n", "") for i in range(20)]
ABSTRACT_LINE = "ABSTRACT\n"
APJ_START, APJ_END = "Introduction\n", "\n2."
MNRAS_START, MNRAS_END = "INTRODUCTION\n", "\n2 "

# Fixed values. ASCII punctuation in code-point order; tokens that are a substring of it are dropped.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Fixed values. Characters trimmed around a text (white space in the Unicode sense).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

# Fixed values. Token patterns.
WORD_RUN = r"[\p{L}\p{N}_]{2,}"
TOKEN_OR_SYMBOL = r"[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]+"
BYTE_LEVEL_WORD = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
END_OF_TEXT = "<|endoftext|>"

# Fixed values. Abstract page of the literature service.
ABSTRACT_URL = "https://ui.adsabs.harvard.edu/abs/%s/abstract"
SERVICE_URL = "https://ui.adsabs.harvard.edu"
