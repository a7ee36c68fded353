"""The recorded plan: operator types, DAG, recording and drawing."""
