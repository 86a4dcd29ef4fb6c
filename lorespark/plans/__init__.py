"""lorespark.plans"""
