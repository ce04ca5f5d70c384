"""Fixed values of the text rules: word lists, ladders and patterns that results depend on, whole and in their order."""

# Technical names of several characters that stay whole as tokens.
TECH_LITERALS = [
    "c++", "c#", "f#", ".net", "asp.net", "node.js", "next.js", "vue.js",
    "react.js", "scikit-learn", "ci/cd", "objective-c", "t-sql", "pl/sql",
    "power bi", "google cloud", "big query", "d3.js", "socket.io",
]
# Short tokens that count whatever their length.
SHORT_TECH_TOKENS = [
    "r", "c", "go", "ai", "ml", "bi", "ux", "ui", "qa", "os", "db", "js",
    "gcp", "aws", "sql", "etl", "nlp", "api", "cv", "rl", "3d",
]
# Words that carry no signal.
STOPWORDS = """
a about above after again all also am an and any are as at be because been before being below between both but by can did do does
doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more
most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them
then there these they this those through to too under until up very was we were what when where which while who whom why will with would
you your yours
ability applicant apply benefit benefits candidate candidates career company culture employer equal experience gender identity including
job know level location minimum opportunity orientation per please plus position preferred qualification qualifications regardless
relevant requirement requirements responsibility responsibilities role salary sexual skill skills team us work working year years
""".split()
# Typographic characters and their plain forms.
TYPOGRAPHY = {
    "—": "-", "–": "-", "‒": "-", "−": "-",
    "‘": "'", "’": "'", "‚": "'", "′": "'",
    "“": '"', "”": '"', "„": '"', "″": '"',
    "…": "...", "•": " ", "·": " ", "→": " ",
    "\u00a0": " ", "\u200b": " ", "\ufeff": " ",
    "€": " EUR ", "£": " GBP ", "¥": " JPY ", "₹": " INR ", "₩": " KRW ",
}
# Phrases from which on a description is legal text.
NOTICES = ["google is proud to be an equal opportunity", "we are an equal opportunity employer", "equal employment opportunity"]
# Brands of a group, first match wins, and marks of third parties that only name it.
BRANDS = [
    ("Waymo", r"\bwaymo\b"),
    ("Verily", r"\bverily\b"),
    ("DeepMind", r"deep\s*mind"),
    ("YouTube", r"\byoutube\b"),
    ("Google Fiber", r"google\s+fiber"),
    ("Mandiant", r"\bmandiant\b"),
    ("Google Operations Center", r"google\s+operations\s+center"),
    ("Google", r"\bgoogle\b|\balphabet\b"),
]
THIRD_PARTY = r"premier partner|reseller|partner\b.*\bgoogle|consultancy|geoambiente"
# Role nouns that show a title in the employer's field.
LEAKED_ROLE = r"\b(engineer|scientist|analyst|manager|developer)\b"
# Seniority levels, first match wins.
SENIORITY = [
    ("Intern", r"\b(intern|internship|apprentice|co-?op|trainee)\b"),
    ("Director+", r"\b(director|head of|vice president|vp|chief)\b"),
    ("Principal", r"\b(principal|distinguished|fellow)\b"),
    ("Senior Staff", r"\b(senior|sr\.?)\s+staff\b"),
    ("Staff", r"\bstaff\b"),
    ("Lead", r"\b(lead|leader)\b"),
    ("Senior", r"\b(senior|sr\.?)\b"),
    ("Junior", r"\b(junior|jr\.?|associate|entry[\s-]level)\b"),
]
# Managers who manage no people.
IC_MANAGER = r"\b(product|program|project|account|marketing|engagement|partner|category|relationship|technology|technical program|supply chain|community|content)\s+manager\b"
# Technology categories, first match wins.
CATEGORIES = [
    ("Data Center / Facilities", r"data\s*cent(er|re)|\b(mechanical|electrical|hvac|plant|facilities|technician|controls|construction)\b"),
    ("AI / ML", r"machine learning|\bml\b|\bai\b|artificial intelligence|deep learning|\bnlp\b|computer vision|research scientist|generative|\bllm\b"),
    ("Data Science", r"data scien|\bstatistic|quantitative|biostatistic|\bmodel(l)?ing\b"),
    ("Data Engineering", r"data engineer|data architect|\betl\b|data pipeline|big data|data platform|data warehouse|database|\bdba\b|data management|informatics"),
    ("Data Analytics / BI", r"analyst|analytics|business intelligence|\bbi\b|insight|reporting"),
    ("Cloud / Infrastructure", r"cloud|customer engineer|solutions? (architect|engineer)|\bdevops\b|\bsre\b|site reliability|infrastructur|network|systems engineer|security engineer"),
    ("Hardware / Silicon", r"\bsilicon\b|hardware|\brf\b|\basic\b|firmware|circuit|semiconductor|\bchip\b|soc\b"),
    ("Software Engineering", r"software engineer|\bswe\b|developer|full[\s-]stack|front[\s-]?end|back[\s-]?end|android|\bios\b|mobile engineer|test engineer|\bsdet\b|\bqa\b"),
    ("Research / Academic", r"student researcher|research (intern|assistant|program)|\bphd\b"),
    ("Product / Program", r"product manager|program manager|\btpm\b|product owner"),
    ("Sales / Marketing / GTM", r"sales|marketing|account (executive|manager)|business development|partnership|go[\s-]to[\s-]market"),
    ("Business / Strategy / Ops", r"business|strategy|operations|finance|legal|recruit|administrative|people\b"),
]
# Work functions, first match wins.
FUNCTIONS = [
    ("Facilities / Operations", r"data\s*cent(er|re)|\b(mechanical|electrical|hvac|plant|facilities|technician|controls|construction)\b"),
    ("Technical Sales", r"customer engineer|sales engineer|solutions? (architect|consultant)|pre[\s-]?sales|technical account manager"),
    ("Sales", r"\bsales\b|account executive|business development|\bquota\b"),
    ("Analytics", r"analyst|analytics|business intelligence|\bbi\b|insight|reporting|metrics"),
    ("Science / Research", r"scientist|research|\bstatistic|quantitative|\bphd\b"),
    ("Engineering", r"engineer|developer|architect|\bsre\b|\bdevops\b|programmer"),
    ("Product / Program", r"product manager|program manager|\btpm\b|product owner"),
    ("Marketing / Communications", r"marketing|brand|communications"),
    ("Support / Admin", r"administrative|business partner|recruit|\bhr\b|legal|finance|specialist|coordinator"),
]
# Nouns of which a usable title has one.
ROLE_NOUNS = (
    "engineer|scientist|analyst|manager|developer|architect|specialist|technician|researcher|lead|director|intern|consultant|designer|"
    "representative|partner|negotiator|coordinator|administrator|advisor|apprentice|associate|instructor|owner|strategist|head of|chief|"
    "president|officer|counsel|trainee"
)
# Places that are none.
REMOTE = r"\b(anywhere|remote|work from home|wfh)\b"
# Codes of United States states and territories.
US_STATES = """
AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT
VA WA WV WI WY DC PR
""".split()
# Other spellings of countries.
COUNTRY_ALIASES = {
    "uk": "United Kingdom", "u.k.": "United Kingdom", "great britain": "United Kingdom", "england": "United Kingdom",
    "usa": "United States", "us": "United States", "u.s.": "United States", "u.s.a.": "United States",
    "uae": "United Arab Emirates", "korea": "South Korea", "czech republic": "Czechia", "turkey": "Turkiye",
}
# Countries that may end a place without a comma.
COUNTRY_SUFFIXES = [
    "Saudi Arabia", "United Arab Emirates", "United States", "United Kingdom", "South Korea", "South Africa", "New Zealand",
    "Dominican Republic", "Costa Rica", "Hong Kong", "Sri Lanka", "Czech Republic", "Singapore", "Israel", "Ireland", "India",
]
# Marks of a third party that names an employer, and role nouns of a leaked title.
AGENCY = r"\bpartners?\b|\breseller\b|\brecruit(ing|ment)?\b|\bstaffing\b|\bconsultanc(y|ies)\b|\bbusiness\s+group\b|\btalent\s+(solutions|acquisition)\b"
EMPLOYER_ROLE = r"\b(engineer|scientist|analyst|manager|developer|architect)\b"
# Words before and after a mention that confirm it as a skill; delimiters and words of lists.
QUALIFIER_BEFORE = (
    r"(?:experience|experienced|proficien\w*|expert\w*|knowledge|skilled|skills?|familiar\w*|fluent|competen\w*|background|hands[\s-]?on|using|use of|"
    r"utilis\w*|utiliz\w*|written in|write in|coding in|programming in|stack|technologies|languages?|tools?|frameworks?)\b[^.;!?\n]{0,25}$"
)
QUALIFIER_AFTER = (
    r"^\s*(?:developer|engineer|programming|programmer|language|framework|library|libraries|scripting|script|skills?|experience|expertise|proficiency|"
    r"certification|certified|stack|codebase|components?|cluster|clusters|environment|pipelines?|jobs?|queries|query|dashboards?|models?|"
    r"spreadsheets?|macros|vba|workbooks?)\b"
)
LIST_DELIMITERS = ",;|/&+"
LIST_WORDS = r"\b(?:and|or|plus)\b\s*$"
# Skill categories in order of precedence, and those that say nothing about a technology stack.
SKILL_CATEGORIES = [
    "ML / AI", "Data Engineering", "Programming Language", "Data Science Libraries", "Cloud Platform", "Database", "DevOps / Infrastructure",
    "Analytics / BI", "Web / Frontend", "OS / Shell", "Governance / Compliance", "Facilities / Data Centre", "Office / Productivity",
]
NON_STACK = ["Office / Productivity", "Governance / Compliance", "Facilities / Data Centre"]
# Terms that are no skills.
EXCLUDED_TERMS = ["flow", "terminal"]
