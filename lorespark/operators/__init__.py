"""lorespark.operators"""
