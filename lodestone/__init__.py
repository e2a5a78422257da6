"""A Spark-native engine for analysing source trees and the tables they give."""
