"""What people write instead of the entries of the reference lists (fixed values of general knowledge).

Spellings that differ only in case, blanks and punctuation need no entry here.
"""

from __future__ import annotations

#: Skills: canonical value -> other names.
SKILLS: dict[str, tuple[str, ...]] = {
    "Python": ("python3", "py", "python, scripting"),
    "JavaScript": ("js", "ecmascript", "es6"),
    "TypeScript": ("ts",),
    "Java": ("core java", "j2se", "j2ee"),
    "C++": ("cpp", "c plus plus"),
    "C#": ("csharp", "c sharp"),
    "Go": ("golang", "go lang"),
    "Rust": ("rustlang", "rust lang"),
    "R": ("r-lang", 'the "r" language', "r language"),
    "SQL": ("structured query language", "sql, analytical"),
    "PostgreSQL": ("postgres", "psql", "pg"),
    "MySQL": (),
    "MongoDB": ("mongo",),
    "Redis": ("redis cache",),
    "Apache Spark": ("spark", "pyspark"),
    "Apache Kafka": ("kafka",),
    "Apache Airflow": ("airflow",),
    "Hadoop": ("hdfs", "hadoop ecosystem", "apache hadoop"),
    "Kubernetes": ("k8s", "kube"),
    "Docker": ("dockerfile", "docker containers"),
    "Terraform": ("tf (terraform)", "hashicorp terraform"),
    "Ansible": ("ansible playbooks",),
    "Amazon Web Services": ("aws", "amazon cloud", "aws (ec2; s3)"),
    "Google Cloud Platform": ("gcp", "google cloud"),
    "Microsoft Azure": ("azure", "ms azure"),
    "CI/CD": ("ci/cd pipelines", "continuous integration / delivery", "continuous integration"),
    "PL/SQL": ("oracle pl/sql",),
    "Git": ("git vcs", "git, branching"),
    "Linux": ("gnu/linux", "linux admin"),
    "React": ("react.js",),
    "Angular": ("angularjs", "angular 2+"),
    "Vue.js": ("vue",),
    "Node.js": ("node",),
    "Django": ("django framework",),
    "Flask": ("python flask",),
    "Spring Boot": ("spring framework",),
    "PyTorch": ("torch",),
    "scikit-learn": ("sklearn",),
    "Pandas": ("pandas lib",),
    "Machine Learning": ("ml",),
    "Deep Learning": ("dl", "deep nets"),
    "Natural Language Processing": ("nlp", "text mining / nlp"),
    "Computer Vision": ("cv (vision)", "image recognition"),
    "Data Modelling": ("data modeling", "data modelling (star, snowflake)"),
    "Tableau": ("tableau dashboards",),
    "Power BI": ("ms power bi", "microsoft power bi"),
    "Microsoft Excel": ("excel", "ms excel", "excel, advanced", "excel; macros | vba"),
    "Project Management": ("pm", "project management; agile"),
    "Scrum": ("scrum master",),
    "Jira": ("atlassian jira",),
    "REST APIs": ("rest", "restful services", "rest api"),
    "Elasticsearch": ("elastic", "es (search)"),
    "Snowflake": ("snowflake dwh",),
    "Customer Support": ("client support", "helpdesk"),
    "Technical Writing": ("tech writing",),
    "Figma": ("figma design",),
    "SAP": ("sap erp", "sap r/3"),
    "Salesforce": ("sfdc", "sales force crm"),
}

#: Countries: canonical value -> ISO 3166 codes.
COUNTRY_CODES: dict[str, tuple[str, str]] = {
    "United States": ("us", "usa"), "United Kingdom": ("gb", "gbr"), "Germany": ("de", "deu"), "France": ("fr", "fra"), "India": ("in", "ind"), "Portugal": ("pt", "prt"), "Poland": ("pl", "pol"), "Sweden": ("se", "swe"), "Norway": ("no", "nor"),
    "Denmark": ("dk", "dnk"), "Finland": ("fi", "fin"), "Argentina": ("ar", "arg"), "Brazil": ("br", "bra"), "Mexico": ("mx", "mex"), "Canada": ("ca", "can"), "Austria": ("at", "aut"), "Australia": ("au", "aus"), "New Zealand": ("nz", "nzl"),
    "Turkey": ("tr", "tur"), "Greece": ("gr", "grc"), "Czechia": ("cz", "cze"), "Ireland": ("ie", "irl"), "Netherlands": ("nl", "nld"), "Belgium": ("be", "bel"), "Switzerland": ("ch", "che"), "Spain": ("es", "esp"), "Italy": ("it", "ita"),
    "Japan": ("jp", "jpn"), "South Korea": ("kr", "kor"), "Nigeria": ("ng", "nga"), "Niger": ("ne", "ner"), "South Africa": ("za", "zaf"), "Slovakia": ("sk", "svk"), "Slovenia": ("si", "svn"), "United Arab Emirates": ("ae", "are"),
}

#: Countries: canonical value -> other names.
COUNTRIES: dict[str, tuple[str, ...]] = {
    "United States": ("the states", "america", "united states of america", "the united states"),
    "United Kingdom": ("uk", "great britain", "britain", "england", "scotland", "wales", "northern ireland", "the united kingdom"),
    "Germany": ("deutschland", "brd", "allemagne", "federal republic of germany", "alemania"),
    "France": ("république française", "frankreich", "french republic", "francia"),
    "India": ("bharat", "republic of india", "indien", "inde"),
    "Portugal": ("república portuguesa",),
    "Poland": ("polska", "polen", "pologne"),
    "Sweden": ("sverige", "schweden", "suède"),
    "Norway": ("norge", "noreg", "norwegen"),
    "Denmark": ("danmark", "dänemark"),
    "Finland": ("suomi", "finnland"),
    "Argentina": ("argentinien", "argentine republic"),
    "Brazil": ("brasil", "brasilien"),
    "Mexico": ("méxico", "mejico", "méjico", "mexiko"),
    "Canada": ("kanada",),
    "Austria": ("österreich", "oesterreich"),
    "Australia": ("oz", "commonwealth of australia", "australien"),
    "New Zealand": ("aotearoa", "n. zealand", "neuseeland"),
    "Turkey": ("türkiye", "turkiye", "türkei", "republic of turkey"),
    "Greece": ("hellas", "ελλάδα", "griechenland", "hellenic republic"),
    "Czechia": ("czech republic", "česko", "the czech republic", "česká republika", "tschechien"),
    "Ireland": ("éire", "eire", "republic of ireland", "irland"),
    "Netherlands": ("the netherlands", "holland", "nederland", "niederlande", "pays-bas"),
    "Belgium": ("belgique", "belgië", "belgien", "belgie"),
    "Switzerland": ("schweiz", "suisse", "svizzera", "swiss confederation"),
    "Spain": ("españa", "espana", "spanien", "espagne"),
    "Italy": ("italia", "italien", "italie"),
    "Japan": ("nippon", "nihon"),
    "South Korea": ("korea (south)", "s. korea", "republic of korea", "korea, south", "korea, republic of"),
    "Nigeria": ("federal republic of nigeria",),
    "Niger": ("niger republic", "republic of niger", "republic of the niger"),
    "South Africa": ("rsa", "s. africa", "republic of south africa", "südafrika"),
    "Slovakia": ("slovak republic", "slovensko", "slowakei"),
    "Slovenia": ("slovenija", "slowenien", "republic of slovenia"),
    "United Arab Emirates": ("uae", "emirates", "the emirates"),
}

#: Job titles: canonical value -> other names.
TITLES: dict[str, tuple[str, ...]] = {
    "Software Engineer": ("software developer", "programmer", "swe", "engineer, software", "software eng."),
    "Backend Developer": ("back-end engineer", "backend eng", "server-side developer", "backend engineer"),
    "Frontend Developer": ("front end engineer", "front-end dev", "ui developer", "frontend engineer"),
    "Full Stack Developer": ("fullstack engineer", "full-stack dev", "full stack engineer"),
    "Mobile Developer": ("mobile app engineer", "app developer", "ios/android developer"),
    "Data Scientist": ("data science specialist", "scientist, data"),
    "Data Engineer": ("big data engineer", "etl developer", "data eng."),
    "Data Analyst": ("bi analyst", "analyst (data)", "reporting analyst"),
    "Machine Learning Engineer": ("ml engineer", "ml eng.", "machine-learning developer"),
    "DevOps Engineer": ("devops specialist", "dev ops eng"),
    "Site Reliability Engineer": ("sre", "reliability engineer"),
    "Database Administrator": ("dba", "db administrator", "database admin"),
    "System Administrator": ("sysadmin", "systems admin", "systems administrator"),
    "Network Engineer": ("netwerk engineer", "network specialist"),
    "Security Analyst": ("cyber security analyst", "infosec analyst"),
    "QA Engineer": ("tester", "test engineer", "quality assurance eng.", "quality assurance engineer"),
    "Product Manager": ("prod. mgr", "pm (product)"),
    "Project Manager": ("proj mgr", "manager, projects"),
    "Scrum Master": ("agile coach / scrum master",),
    "Business Analyst": ("ba", "biz analyst"),
    "Solutions Architect": ("solution architect", "architect, solutions"),
    "UX Designer": ("user experience designer", "ui/ux designer"),
    "Graphic Designer": ("grafik designer", "visual designer"),
    "Technical Writer": ("tech writer", "documentation specialist"),
    "Customer Support Specialist": ("support rep", "helpdesk agent", "customer support rep"),
    "Sales Manager": ("sales mgr.", "head of sales"),
    "Account Manager": ("acct manager", "key account mgr", "key account manager"),
    "Marketing Specialist": ("marketer", "mktg specialist"),
    "HR Generalist": ("hr officer", "human resources generalist"),
    "Recruiter": ("sourcer", "talent acquisition partner"),
    "Accountant": ("book-keeper / accountant", "buchhalter", "book-keeper"),
    "Financial Analyst": ("finance analyst", "analyst, finance"),
    "Operations Manager": ("ops manager", "manager of operations"),
    "Logistics Coordinator": ("logistics co-ordinator", "shipping coordinator"),
    "Warehouse Supervisor": ("warehouse lead", "whse supervisor"),
}

#: Words before or after a title that tell the level.
LEVELS = ("senior", "sr", "snr", "junior", "jr", "jnr", "lead", "principal", "staff", "chief", "associate", "assistant", "trainee", "intern", "mid", "mid-level", "entry-level", "i", "ii", "iii", "iv", "v", "1", "2", "3")
#: Words after a title that tell the working mode.
MODES = ("remote", "hybrid", "onsite", "on-site", "contract", "contractor", "temp", "temporary", "permanent", "part-time", "part time", "full-time", "full time", "fulltime", "freelance", "night shift", "day shift", "m/f/x", "m/w/d", "f/m/d", "m/f/d", "w/m/d", "home office", "100%")

ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "skills_list": SKILLS,
    "location_country": {k: (*COUNTRIES.get(k, ()), *COUNTRY_CODES.get(k, ())) for k in {**COUNTRY_CODES, **COUNTRIES}},
    "job_title": TITLES,
}
