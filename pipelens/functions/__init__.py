"""Feature transformers and models."""

from pipelens.functions.models import (
    DecisionTreeClassifier, GridSearch, LogisticRegression, MLPClassifier, OLS, SGDClassifier, accuracy,
)
from pipelens.functions.transformers import (
    ColumnTransformer, FunctionTransformer, HashingVectorizer, KBinsDiscretizer, OneHotEncoder, Pipeline, SimpleImputer, StandardScaler, Word2Vec,
)

__all__ = [
    "ColumnTransformer", "DecisionTreeClassifier", "FunctionTransformer", "GridSearch", "HashingVectorizer", "KBinsDiscretizer",
    "LogisticRegression", "MLPClassifier", "OLS", "OneHotEncoder", "Pipeline", "SGDClassifier", "SimpleImputer", "StandardScaler",
    "Word2Vec", "accuracy",
]
