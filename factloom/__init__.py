"""factloom: a PySpark-native engine for grounded, measured facts.

Page text becomes facts, facts become reconciled pairs, and both are queried; every stage is a function from
DataFrame to DataFrame.  See README.md for the map of modules.
"""
