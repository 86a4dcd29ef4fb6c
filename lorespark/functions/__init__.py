"""lorespark.functions"""
