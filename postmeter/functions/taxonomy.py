"""The taxonomy of skills of posting texts."""

from __future__ import annotations

from postmeter.operators.skills import Skill

#: Skills by category, each with the strings that also name it. ! marks names that are ordinary words and need a
#: confirmation in free text, * marks methods, which are no tools.
SKILLS = """
[Programming Language]
Python = python3, python 3
SQL
!R
!C
C++ = cpp, c plus plus
C# = csharp, c sharp
Java
!Go = golang
JavaScript = js
TypeScript = ts
Scala
MATLAB
Perl
!Rust
Kotlin
!Swift
Objective-C = objective c, objc
PHP
!Ruby
!Dart
!Julia
!Assembly
VBA
!Groovy
[ML / AI]
TensorFlow = tensor flow
PyTorch = torch
Keras
scikit-learn = sklearn, scikit learn
MXNet
!JAX
XGBoost
LightGBM
OpenCV
spaCy
NLTK
Hugging Face = huggingface
!Transformers
LangChain
CUDA
ONNX
TensorRT
!Ray
MLflow = ml flow
Kubeflow
Vertex AI = vertexai
SageMaker = sage maker
*Machine Learning = ml
*Deep Learning
*NLP = natural language processing
*Computer Vision
*Reinforcement Learning = rl
*Generative AI = genai, gen ai
*LLM = llms, large language model, large language models
!*RAG = retrieval augmented generation
*Recommender Systems = recommendation systems
[Data Science Libraries]
!pandas
NumPy = numpy
SciPy
Matplotlib
Seaborn
Plotly
Jupyter = jupyter notebook, jupyterlab
ggplot2 = ggplot
dplyr
[Data Engineering]
!Spark = apache spark, pyspark
Hadoop = apache hadoop
Kafka = apache kafka
Airflow = apache airflow
dbt
!Apache Beam = beam
Flink = apache flink
!Hive = apache hive
!Presto
Trino
NiFi
Delta Lake
*ETL = elt, etl/elt
*Data Modelling = data modeling, data modelling
[Database]
MongoDB = mongo
MySQL
PostgreSQL = postgres, postgresql
SQL Server = mssql, microsoft sql server
Oracle
Cassandra
Elasticsearch = elastic search
Redis
NoSQL
Bigtable = big table
!Spanner
DynamoDB
Neo4j
SQLite
MariaDB
Microsoft Access = ms access
[Cloud Platform]
GCP = google cloud, google cloud platform
AWS = amazon web services
Azure = microsoft azure
BigQuery = big query
Snowflake
Redshift = amazon redshift
Databricks
Firebase
OpenStack = open stack
VMware = vm ware
S3 = amazon s3
[DevOps / Infrastructure]
Kubernetes = k8s
Docker
Terraform
Jenkins
Ansible
!Chef
!Puppet
!Git
GitHub = github actions
GitLab
Prometheus
Grafana
Splunk
Bazel
!Helm
*CI/CD = ci/cd, cicd, ci cd
[Analytics / BI]
Looker = looker studio
Tableau
Power BI = powerbi
SAS
SPSS
Qlik = qlikview, qlik sense
Cognos
MicroStrategy = micro strategy
Alteryx
Stata
Google Analytics
SAP
[Database]
SAP HANA = hana
[Analytics / BI]
!Excel = microsoft excel, ms excel
!Google Sheets = sheets, spreadsheets
Data Studio
[Web / Frontend]
!React = react.js, reactjs
!Angular = angularjs
Vue.js = vue, vuejs
Node.js = node, nodejs
!Express = express.js, expressjs
Django
!Flask
!Spring
.NET = .net, dotnet, asp.net
Ruby on Rails = rails, ruby on rails
HTML = html5
CSS = css3
GraphQL = graph ql
Flutter
[OS / Shell]
Linux
Unix
!Windows
macOS = mac os, osx
Ubuntu
Bash
!Shell = shell scripting
PowerShell = power shell
[Governance / Compliance]
GDPR
HIPAA
SOC 2 = soc2
ISO 27001
CCPA
[Facilities / Data Centre]
Colocation = colo
HVAC
SCADA
AutoCAD = auto cad
BMS
PLC
[Office / Productivity]
!Microsoft Word = word, ms word
Microsoft Outlook = outlook, ms outlook
PowerPoint = power point, ms powerpoint
SharePoint = share point
Jira
Confluence
"""
#: Patterns that stand for a name and its other strings in free text.
PATTERNS = {"Go": (r"\bgo\b(?!\s*[-\s]?to[-\s]market)",)}
#: Patterns that confirm a name which is an ordinary word.
QUALIFIERS = {
    "R": (r"\br\s*studio\b", r"\brstudio\b", r"\br\s*/\s*python", r"python\s*/\s*r\b", r"\br\s+shiny\b", r"\bin r\b"),
    "C": (r"\bc\s*/\s*c\+\+", r"\bansi c\b", r"\bembedded c\b"),
    "Go": (r"\bgolang\b", r"\bgo\s+lang\b"),
    "Transformers": (r"\btransformer\s+(?:models?|architectures?)\b",),
    "Ray": (r"\bray\s+(?:tune|serve|cluster)\b",),
    "pandas": (r"\bpandas\s*[,/]", r"python.{0,30}\bpandas\b"),
    "Spark": (r"\bapache\s+spark\b", r"\bpy\s?spark\b", r"\bspark\s+sql\b"),
    "Apache Beam": (r"\bapache\s+beam\b", r"\bdataflow\b"),
    "Hive": (r"\bapache\s+hive\b", r"\bhive\s*ql\b"),
    "Spanner": (r"\bcloud\s+spanner\b",),
    "Chef": (r"\bchef\s+(?:cookbook|recipe|infra)", r"puppet.{0,20}\bchef\b", r"\bchef\b.{0,20}puppet"),
    "Git": (r"\bgit\s+(?:repo|branch|flow)",),
    "Excel": (r"\b(?:microsoft|ms)\s+excel\b", r"\bexcel\s+(?:spreadsheet|model|macro|pivot|vba)", r"\badvanced excel\b"),
    "Google Sheets": (r"\bgoogle\s+sheets\b",),
    "React": (r"\breact\.?js\b", r"\breact\s+native\b", r"\breact\s+hooks?\b"),
    "Express": (r"\bexpress\.?js\b", r"\bnode.{0,15}express\b"),
    "Spring": (r"\bspring\s+(?:boot|framework|mvc)\b",),
    "Windows": (r"\b(?:microsoft\s+)?windows\s+(?:server|10|11|admin)", r"\bwindows\s*/\s*linux", r"\blinux\s*/\s*windows"),
    "Shell": (r"\bshell\s+script", r"\b(?:bash|unix|linux)\s+shell\b"),
    "Microsoft Word": (r"\b(?:microsoft|ms)\s+word\b",),
}


def taxonomy() -> list[Skill]:
    """The table above as Skill rows, in its order."""
    out, category = [], ""
    for line in SKILLS.strip().splitlines():
        if line.startswith("["):
            category = line[1:-1]
            continue
        name, _, others = line.partition(" = ")
        marks, name = name[: len(name) - len(name.lstrip("!*"))], name.lstrip("!*")
        aliases = tuple(x for x in others.split(", ") if x)
        out.append(Skill(name, category, aliases, PATTERNS.get(name, ()), "!" in marks, QUALIFIERS.get(name, ()), "*" in marks))
    return out
