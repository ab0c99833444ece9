"""Field maps, the article schema and small dictionaries. Their order and spelling are part of the results."""

from __future__ import annotations

from pyspark.sql import types as T

MISSING = ("", "na", "n/a", "nan", "none", "null", "<na>")
DATABASES = ("Scopus", "Web of Science")
SOURCE_FILE = "__source_file__"
EXTENSIONS = (".csv", ".txt", ".xls", ".xlsx")

#: Export field -> article field.
SCOPUS = {
    "Authors": "Authors", "Author full names": "Author Full Names", "Title": "Title", "Source title": "Source Title",
    "Year": "Publication Year", "Volume": "Volume", "Issue": "Issue", "Art. No.": "Article Number", "Page start": "Start Page",
    "Page end": "End Page", "Page count": "Number of Pages", "Cited by": "Cited by", "DOI": "DOI", "Abstract": "Abstract",
    "Author Keywords": "Author Keywords", "Index Keywords": "Keywords Plus", "Language of Original Document": "Language",
    "Document Type": "Document Type", "Conference name": "Conference Title", "Conference date": "Conference Date",
    "Conference location": "Conference Location", "Funding Details": "Funding Orgs", "Funding Texts": "Funding Text",
    "Publisher": "Publisher", "ISSN": "ISSN", "ISBN": "ISBN", "Abbreviated Source Title": "Journal Abbreviation",
    "Affiliations": "Affiliations", "References": "Cited References Raw", "Cited Reference Count": "Cited Reference Count",
    "Reference Count": "Cited Reference Count", "References Count": "Cited Reference Count",
}
WOS = {
    "Authors": "Authors", "Author Full Names": "Author Full Names", "Article Title": "Title", "Source Title": "Source Title",
    "Publication Year": "Publication Year", "Volume": "Volume", "Issue": "Issue", "Article Number": "Article Number",
    "Start Page": "Start Page", "End Page": "End Page", "Number of Pages": "Number of Pages", "Times Cited, WoS Core": "Cited by",
    "DOI": "DOI", "Abstract": "Abstract", "Author Keywords": "Author Keywords", "Keywords Plus": "Keywords Plus",
    "Language": "Language", "Document Type": "Document Type", "Conference Title": "Conference Title",
    "Conference Date": "Conference Date", "Conference Location": "Conference Location", "Funding Orgs": "Funding Orgs",
    "Funding Text": "Funding Text", "Publisher": "Publisher", "ISSN": "ISSN", "ISBN": "ISBN",
    "Journal Abbreviation": "Journal Abbreviation", "WoS Categories": "WoS Categories",
    "Web of Science Index": "Web of Science Index", "Research Areas": "Research Areas", "Addresses": "Affiliations",
    "Cited Reference Count": "Cited Reference Count", "Cited References Count": "Cited Reference Count",
    "CR": "Cited References Raw", "Cited References": "Cited References Raw", "Cited References Raw": "Cited References Raw",
    "AU": "Authors", "AF": "Author Full Names", "TI": "Title", "SO": "Source Title", "PY": "Publication Year", "TC": "Cited by",
    "DI": "DOI", "AB": "Abstract", "DE": "Author Keywords", "ID": "Keywords Plus", "LA": "Language", "DT": "Document Type",
    "C1": "Affiliations", "PU": "Publisher", "SN": "ISSN", "NR": "Cited Reference Count",
}
WOS_ALL_CITES, WOS_CORE_CITES = "Times Cited, All Databases", "Times Cited, WoS Core"
#: The article table's columns in order.
ARTICLE_COLUMNS = (
    "Authors", "Author Full Names", "Title", "Source Title", "Publication Year", "Volume", "Issue", "Article Number", "Start Page",
    "End Page", "Number of Pages", "Cited by", "DOI", "Abstract", "Author Keywords", "Keywords Plus", "Language", "Document Type",
    "Conference Title", "Conference Date", "Conference Location", "Funding Orgs", "Funding Text", "Publisher", "ISSN", "ISBN",
    "Journal Abbreviation", "WoS Categories", "Web of Science Index", "Research Areas", "Affiliations", "Cited References Raw",
    "Cited Reference Count", "Primary Database", "Databases", "Source Files",
)
_KINDS = {
    "Publication Year": T.DoubleType(), "Cited by": T.DoubleType(), "Cited Reference Count": T.LongType(),
    "Databases": T.ArrayType(T.StringType()), "Source Files": T.ArrayType(T.StringType()),
}
ARTICLE = T.StructType([T.StructField(c, _KINDS.get(c, T.StringType())) for c in ARTICLE_COLUMNS])

#: Columns by which an export's source is told, and the fields that are required or recommended.
SIGNALS = {
    "Scopus": ("Title", "Author full names", "Source title", "Year", "Cited by", "Index Keywords", "Art. No.", "Affiliations", "References"),
    "WoS": ("Article Title", "Source Title", "Publication Year", "Times Cited, WoS Core", "WoS Categories", "Addresses", "CR", "TI", "SO", "AU"),
}
REQUIRED = {"Scopus": (("Title",),), "WoS": (("Article Title",), ("TI",))}
RECOMMENDED = {
    "Scopus": (
        "Authors", "Author full names", "Source title", "Year", "Cited by", "DOI", "Abstract", "Author Keywords", "Index Keywords",
        "Document Type", "Affiliations", "References",
    ),
    "WoS": (
        "Authors", "Author Full Names", "Source Title", "Publication Year", "Times Cited, WoS Core", "Times Cited, All Databases", "DOI",
        "Abstract", "Author Keywords", "Keywords Plus", "Document Type", "Addresses", "CR",
    ),
}
REFERENCE_COLUMNS = ("References", "CR", "Cited References", "Cited References Raw")
TAGS_WITH_SEVERAL = ("AU", "AF", "C1", "CR", "DE", "ID")

#: Document types as exported, lower case -> normal form; all others are "Other".
DOC_TYPES = {
    "article": "Article", "journal article": "Article", "review": "Review", "review article": "Review", "survey": "Review",
    "conference paper": "Conference", "proceeding paper": "Conference", "conference proceeding": "Conference",
    "book chapter": "Book Chapter", "book": "Book",
}
NO_TYPE = "Missing/Incomplete data"
ACRONYMS = ("ieee", "acm", "spie", "nasa", "mnras", "pasp", "aaas", "plos")
SMALL_WORDS = ("a", "an", "the", "and", "or", "but", "for", "nor", "on", "at", "to", "from", "by", "of", "in")

EU27 = (
    "Austria", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czechia", "Denmark", "Estonia", "Finland", "France", "Germany", "Greece",
    "Hungary", "Ireland", "Italy", "Latvia", "Lithuania", "Luxembourg", "Malta", "Netherlands", "Poland", "Portugal", "Romania",
    "Slovakia", "Slovenia", "Spain", "Sweden",
)
#: Scope -> (only EU countries, publication type).
SCOPES = {
    "Global_All": (False, "All"), "Global_MCP": (False, "MCP"), "Global_SCP": (False, "SCP"),
    "EU_All": (True, "All"), "EU_MCP": (True, "MCP"), "EU_SCP": (True, "SCP"),
}

#: Country spellings in capitals -> name.
COUNTRY_ALIASES = {
    "PEOPLES R CHINA": "China", "PEOPLES R. CHINA": "China", "PEOPLES REP CHINA": "China", "PEOPLES REPUBLIC CHINA": "China",
    "UNITED STATES OF AMERICA": "United States", "USA": "United States", "U.S.A.": "United States",
    "UNITED KINGDOM": "United Kingdom", "ENGLAND": "United Kingdom", "SCOTLAND": "United Kingdom",
    "NORTHERN IRELAND": "United Kingdom", "UK": "United Kingdom", "U.K.": "United Kingdom", "WALES": "United Kingdom",
    "NORTH IRELAND": "United Kingdom", "TURKEY": "Republic of Türkiye", "TURKIYE": "Republic of Türkiye",
    "U ARAB EMIRATES": "United Arab Emirates", "RUSSIA": "Russia", "RUSSIAN FEDERATION": "Russia", "VATICAN": "Vatican",
    "BOSNIA & HERCEG": "Bosnia and Herzegovina", "BOSNIA & HERCEGOVINA": "Bosnia and Herzegovina", "BRUNEI": "Brunei",
    "DOMINICAN REP": "Dominican Republic", "SOUTH KOREA": "South Korea", "KOREA": "South Korea", "REP OF KOREA": "South Korea",
    "CZECH REPUBLIC": "Czechia", "CZECH REP.": "Czechia", "CZECHIA": "Czechia",
}
#: Names in lower case -> name.
COUNTRY_NAMES = {
    "czech republic": "Czechia", "czech rep.": "Czechia", "czechia": "Czechia", "türkiye": "Republic of Türkiye",
    "turkiye": "Republic of Türkiye", "republic of türkiye": "Republic of Türkiye", "republic of turkiye": "Republic of Türkiye",
    "korea, republic of": "South Korea", "republic of korea": "South Korea", "south korea": "South Korea",
}

#: Institution -> spellings used when no alias table is given.
INSTITUTIONS = {
    "California Institute of Technology": ("caltech", "california institute technology"),
    "Chinese Academy of Sciences": ("chinese academy science", "university chinese academy science", "ucas"),
    "University of California System": ("university california",),
    "University of California Berkeley": ("university calif berkeley", "uc berkeley"),
    "University of California Los Angeles": ("ucla",),
    "University of California Irvine": ("uc irvine",),
    "Johns Hopkins University": ("johns hopkins university", "johns hopkins univ"),
    "Leiden University": ("leiden university", "leiden univ"),
    "NASA": ("nasa",),
    "NASA Ames Research Center": ("nasa ames research center",),
    "INAF": ("inaf",),
    "University of Arizona": ("university arizona", "univ arizona"),
    "Cornell University": ("cornell university", "cornell univ"),
    "University Paris Saclay": ("university paris saclay",),
    "MIT": ("mit",),
    "ETH Zurich": ("eth zurich", "eth zuerich", "eidgenossische technische hochschule zurich"),
    "KU Leuven": ("ku leuven", "katholieke universiteit leuven"),
    "DLR": ("dlr", "german aerospace center", "deutsches zentrum fur luft und raumfahrt"),
    "European Space Agency (ESA)": ("esa", "european space agency"),
    "CNRS": ("cnrs",),
    "CNR": ("cnr",),
    "UFMG": ("ufmg", "federal university of minas gerais"),
    "Sternberg Astronomical Institute": ("sternberg astron inst",),
    "Toulouse School of Economics": ("toulouse sch econ",),
    "Institute of Planetology and Astrophysics of Grenoble": ("inst planetol & astrophys grenoble osug a",),
    "American Museum of Natural History": ("american museum natural history",),
    "Natural History Museum": ("natural history museum",),
    "University of Munster": ("westfalische wilhelms universitat",),
    "Academy of Sciences of the Czech Republic": ("academy of sciences cr",),
    "National Autonomous University of Mexico": ("univ nacl autonoma mexico",),
    "European Space Operations Centre": ("esoc", "european space operat ctr esa esoc"),
    "University of La Laguna": ("university la laguna",),
    "Instituto de Astrofísica de Canarias": ("institute astrofis canarias",),
    "Beihang University": ("beihang university",),
    "Center for Astrophysics | Harvard & Smithsonian": ("center astrophys harvard & smithsonian",),
    "Chalmers University of Technology": ("chalmers university technology",),
    "Delft University of Technology": ("delft university technology",),
    "Austrian Academy of Sciences": ("austrian academy science",),
    "Dublin Institute for Advanced Studies": ("dublin institute adv studies",),
    "European Space Astronomy Centre (ESAC)": ("esac campus",),
    "Complutense University of Madrid": ("university complutense madrid",),
    "Carnegie Institution for Science": ("carnegie institute science",),
    "Aristotle University of Thessaloniki": ("aristotle university thessaloniki",),
    "Eötvös Loránd University": ("eotvos lorand university",),
    "European Southern Observatory (ESO)": ("european southern observatory",),
}
#: Abbreviations as whole words, in order of replacement.
ABBREVIATIONS = (
    ("Engn", "Engineering"), ("Sci", "Science"), ("Tech", "Technology"), ("Technol", "Technology"), ("Tecnol", "Tecnologia"),
    ("Coll", "College"), ("Acad", "Academy"), ("Inst", "Institute"), ("Univ", "University"), ("Hosp", "Hospital"),
    ("Dist", "District"), ("Gen", "General"), ("Natl", "National"), ("Polytech", "Polytechnic"), ("Prov", "Provincial"),
    ("Dept", "Department"), ("Lab", "Laboratory"), ("Politecn", "Politecnico"), ("Res", "Research"), ("Fed", "Federal"),
    ("Aerosp", "Aerospace"), ("Agcy", "Agency"), ("Ctr", "Center"), ("Int", "International"), ("Educ", "Education"),
    ("Nacl", "Nacional"), ("Nazl", "Nazionale"), ("Geofis", "Geofisica"), ("Vulcanol", "Vulcanologia"), ("Obsv", "Observatory"),
    ("Observ", "Observatory"), ("Operat", "Operations"), ("Ist", "Istituto"), ("Sez", "Sezione"), ("Def", "Defense"),
    ("Geosci", "Geoscience"), ("Geol", "Geology"), ("Fis", "Fisica"), ("Sch", "School"), ("Econ", "Economics"),
    ("Appl", "Applied"), ("Nat", "Natural"), ("Hist", "History"), ("Assoc", "Association"), ("Astrobiol", "Astrobiology"),
    ("Med", "Medicine"), ("Min", "Ministry"), ("Environm", "Environmental"), ("Astrofis", "Astrofisica"),
)
#: Acronyms that stay in capitals, and short words that are none.
CAPITALS = (
    "NASA", "CNRS", "ESA", "JAXA", "CNR", "CSIC", "INAF", "UNESP", "UNIFESP", "MIT", "INTA", "ISAS", "CNES", "UKRI", "STFC", "UCL",
    "ETH", "KU", "OSUG", "UFMG", "UCLA", "DLR", "KFKI", "CICESE", "ESAC", "ESO", "ASI",
)
PLAIN_SHORT = (
    "The", "And", "For", "New", "Los", "San", "Via", "Rue", "Des", "Les", "Der", "Und", "Fur", "Univ", "Inst", "Coll", "Dept", "Lab",
    "Cent", "Sect", "Unit", "Area", "City", "Town", "Park", "Road", "Lane", "Blvd", "Pkwy", "East", "West", "Main", "High",
)

#: Words without a topic, by kind.
NOISE = {
    "academic": """article study paper analysis method result conclusion introduction background data approach model system review
        survey case example framework research issue problem purpose abstract objective methodology discussion finding limitation
        implication contribution scope field literature chapter report document project activity process information high low large
        small recent new old current future previous different difference significant significantly several various multiple certain
        individual particular good better best effective efficient novel general specific main major important possible potential""",
    "publisher": """scopus elsevier wos clarivate pubmed scientometrics bibliometric bibliometrix vosviewer citespace incites
        researcherid orcid ieee springer wiley mdpi database index publication author journal conference proceeding university
        institute society nature switzerland ag license exclusive taylor francis group oxford press behalf reserved right publishing
        ltd copyright homepage visit download online open access creative commons attribution distribution reproduction medium
        american japan japanese chinese european""",
    "latex": """amsbsy mathrsfs upgreek minimal amsmath wasysym amsfonts amssymb document mathrm mathbf mathcal text begin end
        equation array comment""",
    "stopwords": """whether also still every across through however although maybe could would may without among amongst various well
        within often mainly rather either neither another already always due first second third one two three fig figure table et al
        etal inc ltd corp via around""",
    "verbs": """use using used show provide propose suggest present train training trained implement implementing implemented perform
        performing performed apply applying applied develop developing developed allow base include require achieve identify evaluate
        compare demonstrate find found describe consider investigate explore aim obtain report change contain occur observe exist
        remain seem appear indicate associate relate consist compose comprise increase measure take""",
}
NOISE_PHRASES = ("web of science", "journal of informetrics")
BLOCKED_PHRASES = (
    "nature switzerland ag", "license nature switzerland", "exclusive license nature", "taylor francis", "taylor francis group",
    "oxford press",
)
#: English function words.
STOPWORDS = """a about above after again against all am an and any are as at be because been before being below between both but by
    can did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if
    in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own
    same she should so some such than that the their theirs them themselves then there these they this those to too under until up
    very was we were what when where which while who whom why will with you your yours yourself yourselves"""
