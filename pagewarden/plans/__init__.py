"""pagewarden.plans"""
