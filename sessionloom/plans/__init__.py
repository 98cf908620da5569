"""sessionloom.plans"""
