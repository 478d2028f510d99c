"""Schemas, column lists and the fixed lookup values of the retention domain.

Everything under "Fixed values" must equal the behaviour being reproduced
(names, thresholds, texts).  They are stated once, in natural order, and the
operators turn them into small dimension DataFrames or CASE expressions.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

SEGMENTS = [
    "Young Professionals",
    "Established Savers",
    "High-Value Clients",
    "At-Risk Seniors",
]
YP, ES, HVC, ARS = SEGMENTS

RISK_LEVELS = ["Low Risk", "Medium Risk", "High Risk", "Very High Risk"]
HIGH_RISK_LEVELS = ["High Risk", "Very High Risk"]
# probability cut points between the four risk levels (p < cut)
RISK_CUTS = [0.25, 0.5, 0.75]

REQUIRED_FIELDS = [
    "CreditScore", "Geography", "Gender", "Age", "Tenure",
    "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember", "EstimatedSalary",
]

# model feature order (20 columns)
FEATURES = [
    "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
    "IsActiveMember", "EstimatedSalary", "Geography_Germany", "Geography_Spain",
    "Gender_Male", "Balance_to_Salary_Ratio", "Credit_to_Salary_Ratio",
    "Age_to_Tenure_Ratio", "Products_per_Tenure", "IsHighValueCustomer",
    "IsLongTermCustomer", "HasMultipleProducts", "IsYoungInactive", "IsOldInactive",
]
CLUSTER_FEATURES = [
    "Age", "Balance", "EstimatedSalary", "CreditScore", "Tenure", "NumOfProducts",
    "IsActiveMember",
]
# one-hot levels: sorted, first level dropped
GEOGRAPHY_LEVELS = ["France", "Germany", "Spain"]
GENDER_LEVELS = ["Female", "Male"]

# batch result columns after the id
BATCH_RESULT_COLUMNS = [
    "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
    "IsActiveMember", "EstimatedSalary", "ChurnProbability", "RiskLevel", "Segment",
]
CUSTOMER_ID_PREFIX = "CUST"
CUSTOMER_ID_BASE = 10000

# defaults used by the per-customer rules when a field is absent
FIELD_DEFAULTS = {
    "Age": 35,
    "IsActiveMember": 1,
    "NumOfProducts": 1,
    "Balance": 75000.0,
    "Geography": "France",
    "Tenure": 5,
    "CreditScore": 650,
    "EstimatedSalary": 50000.0,
}

# cluster id -> name, as assigned by the training script
CLUSTER_NAMES = {0: YP, 1: ES, 2: HVC, 3: ARS}

# segment economics
RETENTION_COST_RATE = {HVC: 0.08, ARS: 0.12}
RETENTION_COST_RATE_OTHER = 0.06
GROWTH_POTENTIAL = {YP: "High", ES: "Medium", HVC: "Medium"}
GROWTH_POTENTIAL_OTHER = "Low"
ROI_PROGRAM_BUDGET = 5000000
ROI_DEFAULT_SHARE_PCT = 25.0
ROI_DEFAULT_CHURN_PCT = 15.0
FINANCE_DEFAULT_LTV = 5000.0
FINANCE_DEFAULT_UNIT_COST = 300.0
DASHBOARD_CUSTOMER_BASE = 10000

# similar-customer estimate
SIMILAR_BASE_COUNT = {YP: 2834, ES: 4270, HVC: 1550, ARS: 1350}
SIMILAR_BASE_COUNT_OTHER = 2500

# churn factors: (factor, impact, score, details template)
FACTOR_INACTIVE = ("Inactive Account Status", "Very High", 0.85,
                   "Inactive members are 4.3x more likely to churn. Customer shows no recent activity.")
FACTOR_SENIOR = ("Senior Age Group", "High", 0.72,
                 "Customers over 60 have 27.4% higher churn risk. Customer age: {Age}")
FACTOR_YOUNG = ("Young Demographics", "Medium", 0.58,
                "Young customers (under 30) show 15.7% higher churn risk due to life transitions. Customer age: {Age}")
FACTOR_SINGLE_PRODUCT = ("Single Product Relationship", "Medium", 0.65,
                         "Single product customers are 2.3x more likely to churn. Customer has {NumOfProducts} product(s).")
FACTOR_OVER_BANKED = ("Over-Banked Customer", "Medium", 0.45,
                      "Customers with 4+ products may be over-banked and prone to consolidation. Customer has {NumOfProducts} products.")
FACTOR_LOW_BALANCE = ("Low Account Balance", "Medium", 0.55,
                      "Low balance accounts show 24.8% churn rate. Customer balance: ${Balance}")
FACTOR_WEALTHY_SENIOR = ("High Balance + Mature Age", "Medium", 0.42,
                         "Wealthy seniors may consolidate accounts. Balance: ${Balance}, Age: {Age}")
FACTOR_GERMANY = ("Geographic Risk - Germany", "Medium", 0.48,
                  "German customers have 26.9% churn rate vs. 15.2% in France")
FACTOR_LOW_TENURE = ("Low Tenure", "High", 0.68,
                     "Customers under 2 years have 30.6% churn rate. Customer tenure: {Tenure} years")
FACTOR_LOW_CREDIT = ("Low Credit Score", "Medium", 0.52,
                     "Low credit scores correlate with financial stress. Customer score: {CreditScore}")
FACTOR_MULTIPLE = ("Multiple Risk Indicators", "High",
                   "Customer profile shows combination of risk factors requiring immediate attention")
FACTOR_MODERATE = ("Moderate Risk Profile", "Medium",
                   "Customer shows moderate churn risk based on behavioral patterns")

# retention strategies shown for one customer: segment -> [(strategy, effectiveness, details)]
SEGMENT_STRATEGIES = {
    YP: [
        ("Digital Experience Enhancement", "High",
         "Upgrade mobile banking features with AI-powered financial insights and budgeting tools"),
        ("Career-Stage Financial Programs", "High",
         "Offer student loan refinancing, first-time homebuyer programs, and investment starter packages"),
        ("Gamified Rewards Program", "Medium",
         "Implement points-based system with instant rewards for digital engagement and savings goals"),
    ],
    ES: [
        ("Premium Relationship Banking", "Very High",
         "Assign dedicated relationship manager with quarterly financial reviews and planning"),
        ("Family Banking Solutions", "High",
         "Create comprehensive family packages with college savings plans and multi-generational benefits"),
        ("Competitive Rate Matching", "High",
         "Implement automatic rate match program for savings and investment products"),
    ],
    HVC: [
        ("Private Wealth Management", "Very High",
         "Provide exclusive access to private banking services with dedicated wealth advisors"),
        ("Alternative Investment Access", "High",
         "Offer exclusive investment opportunities including private equity and hedge fund access"),
        ("Concierge Financial Services", "High",
         "Provide white-glove service including tax planning, estate management, and family office services"),
    ],
    ARS: [
        ("Senior-Focused Accessibility", "Very High",
         "Develop simplified interfaces, priority phone support, and in-branch assistance programs"),
        ("Retirement Income Optimization", "High",
         "Create specialized fixed-income products with guaranteed returns and pension maximization"),
        ("Legacy Planning Services", "Medium",
         "Offer comprehensive estate planning, trust services, and wealth transfer guidance"),
    ],
}
STRATEGY_URGENT = ("Emergency Retention Protocol", "Very High",
                   "Immediate senior management contact with customized retention package and fee waivers")
STRATEGY_REACTIVATION = ("Account Reactivation Campaign", "High",
                         "Targeted outreach with special incentives to re-engage dormant account holders")
STRATEGY_EXPANSION = ("Strategic Product Expansion", "Medium",
                      "Offer complementary products with bundled pricing and relationship bonuses")

# recommendations per risk level; {cost2} / {cost} are money amounts
RISK_RECOMMENDATIONS = {
    "Very High Risk": [
        "Immediate escalation to senior relationship manager within 24 hours",
        "Deploy emergency retention package worth up to ${cost2}",
        "Conduct comprehensive account review to identify pain points",
        "Implement weekly monitoring and proactive outreach for next 3 months",
    ],
    "High Risk": [
        "Schedule relationship manager contact within 48-72 hours",
        "Offer personalized retention incentives up to ${cost}",
        "Review and optimize current product mix and pricing",
        "Implement bi-weekly check-ins for next 2 months",
    ],
    "Medium Risk": [
        "Proactive outreach by customer service team within 1 week",
        "Offer loyalty rewards and product upgrade opportunities",
        "Conduct satisfaction survey to identify improvement areas",
        "Schedule quarterly account reviews",
    ],
    "Low Risk": [
        "Include in regular customer satisfaction monitoring",
        "Offer product expansion opportunities based on life stage",
        "Maintain standard service level with annual reviews",
        "Consider for customer advocacy and referral programs",
    ],
}

# playbooks of the training report: segment strategies and risk strategies
PLAYBOOK_SEGMENT = {
    YP: [
        "Offer mobile banking incentives and digital-first services",
        "Create loyalty programs with quick rewards",
        "Provide financial education resources tailored to early career needs",
        "Offer special rates on first-time home loans or investment accounts",
    ],
    ES: [
        "Provide premium relationship manager services",
        "Offer competitive interest rates on savings products",
        "Create family banking packages with benefits for multiple accounts",
        "Develop retirement planning services and workshops",
    ],
    HVC: [
        "Implement VIP customer service with dedicated advisors",
        "Offer exclusive investment opportunities and wealth management",
        "Provide complimentary financial reviews and tax planning",
        "Create invitation-only events and networking opportunities",
    ],
    ARS: [
        "Develop senior-friendly banking interfaces and support",
        "Offer in-person banking services with no additional fees",
        "Create retirement income products with guaranteed returns",
        "Provide estate planning services and family wealth transfer guidance",
    ],
}
PLAYBOOK_RISK = {
    "Low Risk": [
        "Regular engagement through personalized communications",
        "Cross-sell additional products based on customer needs",
        "Implement loyalty rewards for continued business",
    ],
    "Medium Risk": [
        "Proactive outreach to address potential pain points",
        "Offer account reviews to ensure products match current needs",
        "Provide special promotions to increase product usage",
    ],
    "High Risk": [
        "Immediate contact by relationship managers",
        "Offer retention incentives such as fee waivers or rate improvements",
        "Conduct satisfaction surveys to identify specific issues",
    ],
    "Very High Risk": [
        "Implement emergency retention protocols with significant incentives",
        "Executive-level outreach for high-value customers",
        "Create customized retention packages based on customer history",
    ],
}
# batch report recommendations
PLAYBOOK_OVERALL = [
    "Implement an early warning system to identify customers showing early signs of disengagement",
    "Develop segment-specific retention playbooks for customer service teams",
    "Create a dashboard to track retention campaign effectiveness",
    "Establish regular review cycles to refine strategies based on results",
]
PLAYBOOK_BATCH_SEGMENT = {
    YP: [
        "Digital Experience Enhancement - Upgrade mobile banking features with personalized insights",
        "Early Career Financial Programs - Offer student loan refinancing and first-time homebuyer programs",
        "Micro-Rewards Loyalty Program - Implement points-based system with frequent small rewards",
        "Financial Education Platform - Create interactive learning modules on investing and debt management",
    ],
    ES: [
        "Premium Relationship Banking - Assign dedicated relationship managers with quarterly reviews",
        "Family Banking Packages - Create comprehensive family financial solutions with preferential rates",
        "Rate Match Guarantee - Implement competitive rate match program for savings products",
        "Mid-Life Financial Planning - Develop specialized workshops for college planning and retirement preparation",
    ],
    HVC: [
        "Private Client Services - Provide exclusive banking services with dedicated wealth advisors",
        "Advanced Wealth Management - Offer alternative investments and customized portfolio management",
        "Executive Financial Planning - Provide tax optimization and estate planning services",
        "Exclusive Client Events - Host invitation-only networking events and investment seminars",
    ],
    ARS: [
        "Senior Banking Accessibility - Develop simplified interfaces and priority in-branch service",
        "Retirement Income Solutions - Create specialized fixed-income products with guaranteed returns",
        "Legacy Planning Services - Offer comprehensive estate planning and wealth transfer guidance",
        "Digital Adoption Support - Implement in-branch digital banking workshops and home visit technology setup",
    ],
}

# performance verdict texts
VERDICT_AUC = [
    (0.8, "✓ Excellent model discrimination capability (ROC-AUC > 0.8)"),
    (0.7, "✓ Good model discrimination capability (ROC-AUC > 0.7)"),
    (None, "⚠ Model discrimination needs improvement (ROC-AUC < 0.7)"),
]
VERDICT_F1 = [
    (0.7, "✓ Strong overall performance (F1-Score > 0.7)"),
    (0.6, "✓ Acceptable overall performance (F1-Score > 0.6)"),
    (None, "⚠ Performance needs improvement (F1-Score < 0.6)"),
]
VERDICT_GAP = 0.05
VERDICT_GAP_OK = "✓ Good generalization (CV and test scores are similar)"
VERDICT_GAP_BAD = "⚠ Possible overfitting detected (significant gap between CV and test scores)"

# sample scoring input of the upload template
TEMPLATE_ROWS = [
    ("CUST001", 650, "France", "Female", 35, 5, 75000.0, 1, "Yes", "Yes", 50000.0),
    ("CUST002", 700, "Germany", "Male", 45, 7, 125000.0, 2, "Yes", "No", 75000.0),
    ("CUST003", 750, "Spain", "Female", 55, 9, 50000.0, 1, "No", "Yes", 60000.0),
]

# synthetic customer generator
SYNTH_SURNAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller",
                  "Davis", "Rodriguez", "Martinez"]
SYNTH_GEOGRAPHY_P = [("France", 0.5), ("Spain", 0.2), ("Germany", 0.3)]
SYNTH_PRODUCTS_P = [(1, 0.5), (2, 0.3), (3, 0.15), (4, 0.05)]

# --------------------------------------------------------------------------
# Spark schemas
# --------------------------------------------------------------------------

RAW_CUSTOMER_SCHEMA = T.StructType([
    T.StructField("RowNumber", T.LongType()),
    T.StructField("CustomerId", T.LongType()),
    T.StructField("Surname", T.StringType()),
    T.StructField("CreditScore", T.IntegerType()),
    T.StructField("Geography", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Tenure", T.IntegerType()),
    T.StructField("Balance", T.DoubleType()),
    T.StructField("NumOfProducts", T.IntegerType()),
    T.StructField("HasCrCard", T.IntegerType()),
    T.StructField("IsActiveMember", T.IntegerType()),
    T.StructField("EstimatedSalary", T.DoubleType()),
    T.StructField("Exited", T.IntegerType()),
])

# scoring input: flags kept as text so that Yes/No/1/0 all parse
SCORING_INPUT_SCHEMA = T.StructType([
    T.StructField("CustomerId", T.StringType()),
    T.StructField("CreditScore", T.IntegerType()),
    T.StructField("Geography", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Tenure", T.IntegerType()),
    T.StructField("Balance", T.DoubleType()),
    T.StructField("NumOfProducts", T.IntegerType()),
    T.StructField("HasCrCard", T.StringType()),
    T.StructField("IsActiveMember", T.StringType()),
    T.StructField("EstimatedSalary", T.DoubleType()),
])

FEATURE_IMPORTANCE_SCHEMA = T.StructType([
    T.StructField("Feature", T.StringType()),
    T.StructField("Importance", T.DoubleType()),
])
